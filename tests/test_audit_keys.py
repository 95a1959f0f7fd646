"""Foreign keys are audited all of them, over whole tables, and a table is read once for its keys."""

import re

import __spark_entry__
import pytest
from dossier.operators import audit
from dossier.schemas import RULES


def test_the_query_audits_every_key_over_whole_tables(spark, small):
    sql = __spark_entry__.oracle_sql()["audit_foreign_keys"]
    keys = {f"foreign_key({c})" for rule in RULES.values() for c, _ in rule.foreign}
    assert all(f"'{k}' AS rule" in sql for k in keys) and "id % 5" not in sql
    plan = __spark_entry__.queries()["audit_foreign_keys"](spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"c_custkey#\w+ % ", plan) and len(re.findall(r"SortMergeJoin \[l_orderkey#", plan)) == 1


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_keys_of_several_types(spark, kind):
    tables = {
        "parents": spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long"),
        "named": spark.createDataFrame([("1",), ("x",)], "id string"),
        "children": spark.createDataFrame([(1, 1, "1"), (3, 2, "x"), (3, 4, "y"), (None, None, None)], "a long, b int, c string").selectExpr(f"CAST(a AS {kind}) AS a", "b", "c"),
    }
    rules = {"parents": (), "named": (), "children": (("a", "parents"), ("b", "parents"), ("c", "named"))}
    got = {(r.rule, r.key, r.n_violations) for r in audit.audit_foreign_keys(tables, rules).collect()}
    assert got == {("foreign_key(a)", "3", 2), ("foreign_key(b)", "4", 1), ("foreign_key(c)", "y", 1)}
