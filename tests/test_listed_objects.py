"""Objects listed by tasks: all of them, those without bytes too, with no path on the driver."""

import pytest
from compare import check, connection
from dossier import queries
from dossier.sources import objects
from dossier.streaming import jobs
from pyspark.sql import functions as F


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with an empty text, white space, none at all, a long one and a broken-looking one."""
    texts = ["", " ", None, "word " * 2_000_000, "\ufffd\ue000 \u3000x", "one\ntwo", "", "a", "b b"]
    rows = spark.createDataFrame([(k, t, "en", f"src{k}", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["read_objects", "stream_landing"])
def test_objects_without_bytes_count(spark, odd, name):
    check(queries.QUERIES[name](spark, odd), connection(odd), queries.ORACLE_SQL[name])


def test_the_driver_has_no_list_of_objects(spark, odd):
    plan = queries.QUERIES["read_objects"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" in plan
    plan = queries.QUERIES["read_objects"](spark, odd).select("length")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # contents are read where they are asked for


def bucket(folder):
    for name, content in (("a.txt", b"one two"), ("x/y/z/b.txt", b"three"), ("x/empty.txt", b""), ("x/_hidden.txt", b"1"), (".h/c.txt", b"1"), ("q=1/k v+%20.md", b"5")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


def test_what_is_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(objects, "CONTENT_BYTES", 1)
    bucket(tmp_path / "in")
    for root in (f"{tmp_path}/in", f"file://{tmp_path}/in"):
        got = {r.file_path: (bytes(r.content), r.length) for r in objects.read_listed(spark, root).collect()}
        assert got == {"a.txt": (b"one two", 7), "x/y/z/b.txt": (b"three", 5), "x/empty.txt": (b"", 0), "q=1/k v+%20.md": (b"5", 1)}
    assert {r.file_path for r in objects.read_listed(spark, root, 1).collect()} == {"x/empty.txt", "q=1/k v+%20.md"}
    old = objects.read_objects(spark, root).select("file_path", "modified")
    assert old.exceptAll(objects.list_objects(spark, root).select("file_path", F.date_trunc("millisecond", "modified"))).isEmpty()
    (tmp_path / "none").mkdir()
    assert objects.read_listed(spark, f"{tmp_path}/none").count() == 0


def test_a_stream_finds_each_new_object_once(spark, tmp_path):
    bucket(tmp_path / "in")
    seen = []

    def drain():
        rows = jobs.stream_landing(spark, f"file://{tmp_path}/in")
        rows.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/checkpoint").start().awaitTermination()

    drain()
    assert {r.file_path: r.word_count for r in seen} == {"a.txt": 2, "x/y/z/b.txt": 1, "x/empty.txt": 0, "q=1/k v+%20.md": None} and len(seen) == 4
    (tmp_path / "in" / "x" / "late.txt").write_bytes(b"")
    (tmp_path / "in" / "a.txt").write_bytes(b"again and again")
    drain()
    drain()
    assert [r.file_path for r in seen[4:]] == ["x/late.txt"]


def test_a_stream_keeps_no_paths_on_the_driver(spark, tmp_path):
    bucket(tmp_path / "in")
    jobs.stream_landing(spark, f"file://{tmp_path}/in").writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/checkpoint").start().awaitTermination()
    kept = [p.read_text() for part in ("sources", "offsets", "commits") for p in (tmp_path / "checkpoint" / part).rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert kept and not any("a.txt" in text for text in kept)
