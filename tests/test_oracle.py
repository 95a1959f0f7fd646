"""All queries of the library against their SQL, on the smallest tables, and the shapes of some plans."""

import pytest

from compare import check, connection
from dossier import queries
from dossier.operators import extract, relations
from dossier.sources.objects import read_objects, write_objects
from dossier.standin import Standin


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


def test_every_query_has_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, con, name):
    check(queries.QUERIES[name](spark, small), con, queries.ORACLE_SQL[name])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_out_of_shuffles(spark, small):
    s = Standin(spark, small)
    evidence = s.text_documents()
    rows = relations.evidence_mappings(evidence, s.mappings())
    assert "extracted_text" not in plan(rows.select("evidence_id", "mapping_status"))


def test_contents_are_read_once_and_stay(spark, small, tmp_path):
    root = f"file://{tmp_path}/bucket"
    docs = Standin(spark, small).text_documents()
    write_objects(docs.select("file_path", docs["extracted_text"].cast("binary").alias("content")), root).write.format("noop").mode("overwrite").save()
    docs.select(docs["id"].alias("document_id"), "file_path").write.parquet(f"{tmp_path}/tasks")
    done = extract.process_documents(spark.read.parquet(f"{tmp_path}/tasks"), read_objects(spark, root))
    done.write.format("noop").mode("overwrite").save()
    lines = done._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [x for x in lines if "binaryFile" in x]
    assert sum("content" in x.split("ReadSchema")[1] for x in scans) == 1 and len(scans) == 2
    assert not any("Exchange" in x and "content" in x for x in lines) and not any("SortMergeJoin" in x and "content" in x for x in lines)
    (join,) = [x for x in lines if "BroadcastHashJoin" in x and "Inner" in x]
    assert "BuildRight" in join or "BuildLeft" in join


def test_scans_are_pruned_and_filtered(spark, small):
    text = plan(Standin(spark, small).table("lineitem").where("l_returnflag = 'A'").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in text and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text


def test_stored_facts_meet_without_a_shuffle(spark, small):
    evidence, mappings = queries._facts(Standin(spark, small))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = relations.evidence_mappings(evidence, mappings)
        rows.write.format("noop").mode("overwrite").save()
        text = plan(rows)
        assert "SortMergeJoin" in text and "Exchange" not in text
        s = Standin(spark, small)
        text = plan(relations.evidence_trace(s.organizations(), evidence, mappings, s.requirements(), s.versions(), s.frameworks()))
        assert "hashpartitioning(mapping_evidence_id" not in text and "hashpartitioning(evidence_id" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
