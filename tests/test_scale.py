"""Plans that must not grow faster than their tables, and jobs whose executors share nothing but folders."""

from dossier import standin
from dossier.plans import coverage


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_gaps_neither_shuffle_nor_join_the_grid(spark):
    scope = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (None, 7), (4, None), (5, 9)], "organization_id long, version_id int")
    requirements = spark.createDataFrame([(10, 7), (11, 7), (11, 7), (None, 7), (12, 8), (13, None), (11, 8)], "id long, version_id int")
    mappings = spark.createDataFrame([(1, 10, "approved"), (1, 10, "approved"), (1, 11, "pending"), (2, 11, "approved"), (2, None, "approved"), (3, 12, "approved"), (3, 11, "approved"), (None, 10, "approved")], "organization_id long, requirement_id long, status string")
    got = coverage.coverage_gaps(scope, requirements, mappings)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 7, 11), (1, 7, 11), (1, 7, None), (2, 7, 10), (2, 7, None), (None, 7, 10), (None, 7, 11), (None, 7, 11), (None, 7, None)], key=str)
    plan = plan_of(got)
    above = plan[plan.index("Final Plan") : plan.index("BroadcastHashJoin")] if "Final Plan" in plan else plan[: plan.index("BroadcastHashJoin")]
    assert "LeftAnti" not in plan and "Exchange" not in above and "Sort" not in above


def test_shuffles_are_dealt_by_the_size_of_tables(spark, small, monkeypatch):
    target, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    standin.Standin(spark, small)
    few = int(spark.conf.get(parts))
    assert int(spark.conf.get(target)) == standin.TASK_BYTES
    monkeypatch.setattr(standin, "TASK_BYTES", 4096)
    s = standin.Standin(spark, small)
    many = int(spark.conf.get(parts))
    assert many >= 10 * few
    counted = s.mappings().groupBy("status").count()
    assert "hashpartitioning(status#" in (plan := counted._jdf.queryExecution().executedPlan().toString()) and f", {many})" in plan
    monkeypatch.undo()
    standin.Standin(spark, small)
    assert int(spark.conf.get(parts)) == few


EMBEDDED = """
import sys, tempfile
sys.path[:0] = [{root!r}, {here!r}]
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from dossier.schemas import SCHEMAS
from dossier.sources import database
from test_database import ROWS

folder = tempfile.mkdtemp(prefix="spark-tests-")
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.executorEnv.PYTHONPATH", {root!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{{folder}}").getOrCreate()
url = f"jdbc:derby:{{folder}}/db;create=true"
for name in ("evidence_artifacts", "regulatory_requirements", "compliance_mappings"):
    df = spark.createDataFrame([ROWS[name](k) for k in range(40)], SCHEMAS[name])
    odd = ['a "quoted", text', " spaces ", "two\\nlines\\r\\n", "", None, "back\\\\slash é"]
    if "description" in df.columns or "extracted_text" in df.columns:
        c = "description" if "description" in df.columns else "extracted_text"
        df = spark.createDataFrame([r[: df.columns.index(c)] + (odd[k % 6],) + r[df.columns.index(c) + 1 :] for k, r in enumerate(map(tuple, df.collect()))], SCHEMAS[name])
    assert database.write_entity(df, url, name) == 40
    assert database.write_entity(df.where("id < '00000005'"), url, name) == 5
    got = database.read_entity(spark, url, name, parts=4)
    assert got.schema.names == SCHEMAS[name].names and [f.dataType for f in got.schema] == [f.dataType for f in SCHEMAS[name]]
    assert {{tuple(r) for r in got.collect()}} == {{tuple(r) for r in df.collect()}}, name
print("ROUND TRIP")
"""


def test_embedded_database_of_a_cluster():
    """The database is in the driver's process; executors are processes of their own."""
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(__file__))
    env = {k: v for k, v in os.environ.items() if k == "SPARK_HOME" or "SPARK" not in k} | {"PYTHONPATH": os.path.dirname(here)}
    done = subprocess.run([sys.executable, "-c", EMBEDDED.format(root=os.path.dirname(here), here=here)], capture_output=True, text=True, timeout=300, env=env)
    assert "ROUND TRIP" in done.stdout, done.stderr[-3000:]
