"""Streams give what the batch jobs give, also after a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossier.operators.mutate import latest_status
from dossier.streaming import jobs

T0 = datetime(2024, 1, 1)


def drain(df, mode, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    return df.sparkSession.table(name)


def log(spark, folder, rows):
    at = lambda s: T0 + timedelta(seconds=s)
    spark.createDataFrame([(d, e, at(s), x) for d, e, s, x in rows], "document_id long, event_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("document_id long, event_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_latest_status(spark, tmp_path):
    stream = log(spark, tmp_path / "log", [(1, 1, 0, "PENDING"), (1, 2, 0, "PROCESSING"), (2, 3, 5, "FAILED")])
    got = drain(jobs.stream_latest_status(stream), "complete", tmp_path, "latest").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in latest_status(spark.read.parquet(str(tmp_path / "log"))).collect()}


def test_stuck_documents(spark, tmp_path):
    folder = tmp_path / "log"
    log(spark, folder, [(1, 1, 0, "PROCESSING"), (2, 2, 0, "PROCESSING"), (3, 3, 10, "PENDING")])
    log(spark, folder, [(2, 4, 600, "COMPLETED"), (4, 5, 700, "PROCESSING")])
    stream = log(spark, folder, [(9, 6, 8000, "PENDING")])
    got = drain(jobs.stream_stuck_documents(stream), "append", tmp_path, "stuck").collect()
    assert {(r.document_id, r.since) for r in got} == {(1, T0), (4, T0 + timedelta(seconds=700))}


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one two \xff three")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    got = {r.file_path: (r.extension, r.word_count) for r in drain(jobs.stream_landing(spark, str(tmp_path / "in")), "append", tmp_path, "landing").collect()}
    assert got == {"a.txt": (".txt", 3), "b.pdf": (".pdf", None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_stuck_documents_in_any_order_of_arrival(spark, tmp_path, seed):
    """Files in a shuffled order, within the delay: what a batch over the whole log finds."""
    import random

    rng = random.Random(seed)
    events = [(rng.randint(1, 12), k, rng.randint(0, 20_000), rng.choice(["PROCESSING", "PROCESSING", "COMPLETED", "PENDING"])) for k in range(120)]
    rng.shuffle(events)
    delay = 21_000  # the whole log arrives within it
    for at in range(0, 120, 30):
        log(spark, tmp_path / "log", events[at : at + 30])
    stream = log(spark, tmp_path / "log", [(99, 999, 60_000, "PENDING")])
    got = drain(jobs.stream_stuck_documents(stream, 1800, f"{delay} seconds"), "append", tmp_path, f"shuffled{seed}").collect()
    want = []
    for d in range(1, 13):
        mine = sorted((s, e, x) for k, e, s, x in events if k == d)
        want += [(d, T0 + timedelta(seconds=s)) for (s, _, x), after in zip(mine, [*mine[1:], (60_000 - delay, 0, "")]) if x == "PROCESSING" and after[0] - s > 1800]
    assert sorted((r.document_id, r.since) for r in got) == sorted(want) and len(want) > 5


def test_an_event_that_comes_late_changes_what_is_stuck(spark, tmp_path):
    log(spark, tmp_path / "log", [(1, 2, 300, "COMPLETED"), (2, 3, 300, "PROCESSING")])
    log(spark, tmp_path / "log", [(1, 1, 180, "PROCESSING"), (2, 4, 60, "COMPLETED")])
    stream = log(spark, tmp_path / "log", [(9, 9, 9000, "PENDING")])
    got = drain(jobs.stream_stuck_documents(stream), "append", tmp_path, "late").collect()
    assert [(r.document_id, r.since) for r in got] == [(2, T0 + timedelta(seconds=300))]


def pending(spark, root, ids):
    snaps = jobs.Snapshots(spark, root, partitions=8, text_digits=1)
    snaps.write(spark.createDataFrame([(i, "PENDING") for i in ids], "id string, status string").select("id", "status", *(F.lit(None).cast(t).alias(c) for c, t in (("extracted_text", "string"), ("page_count", "int"), ("word_count", "int"), ("updated_at", "timestamp")))), 0)
    return snaps


def test_process_documents_is_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}"
    snaps = pending(spark, f"{root}/artifacts", ["1", "2"])
    objects = lambda: spark.createDataFrame([("a.txt", b"x y"), ("b.txt", b"z")], "file_path string, content binary")
    for rows in ([("1", "a.txt")], [("2", "gone.txt"), ("2", "gone.txt")], []):
        if rows:
            spark.createDataFrame(rows, "document_id string, file_path string").coalesce(1).write.mode("append").json(f"{root}/queue")
        queue = spark.readStream.schema("document_id string, file_path string").json(f"{root}/queue")
        jobs.stream_process_documents(queue, objects, snaps, f"{root}/checkpoint").awaitTermination()
    running = {(r.id, r.status) for r in snaps.read(before=2).collect()}
    assert running == {("1", "PROCESSING"), ("2", "PENDING")}  # what a reader saw while the first batch ran
    assert snaps.narrow().where("id = '1'").first().extracted_text != "x y" and snaps.read().where("id = '1'").first().extracted_text == "x y"
    assert {(r.id, r.status, r.word_count) for r in snaps.read().collect()} == {("1", "COMPLETED", 2), ("2", "FAILED", None)}


def test_a_batch_rewrites_only_the_partitions_that_it_touches(spark, tmp_path):
    root = f"file://{tmp_path}"
    snaps = pending(spark, f"{root}/artifacts", [str(k) for k in range(100)])
    objects = lambda: spark.createDataFrame([("a.txt", b"x y"), ("b.txt", b"x y"), ("c.txt", b"z")], "file_path string, content binary")
    before = {r.f for r in snaps.narrow().select(F.input_file_name().alias("f")).distinct().collect()}
    for rows in ([("7", "a.txt")], [("8", "b.txt"), ("9", "c.txt")]):
        spark.createDataFrame(rows, "document_id string, file_path string").coalesce(1).write.mode("append").json(f"{root}/queue")
        queue = spark.readStream.schema("document_id string, file_path string").json(f"{root}/queue")
        jobs.stream_process_documents(queue, objects, snaps, f"{root}/checkpoint").awaitTermination()
        if len(rows) == 1:
            after = {r.f for r in snaps.narrow().select(F.input_file_name().alias("f")).distinct().collect()}
            assert len(before - after) == len(after - before) == 1  # one of eight
    got = {r.id: (r.status, r.extracted_text, r.word_count) for r in snaps.read().collect()}
    assert len(got) == 100 and (got["7"], got["8"], got["9"]) == (("COMPLETED", "x y", 2),) * 2 + (("COMPLETED", "z", 1),) and got["1"][0] == "PENDING"
    assert sorted(r.text for r in snaps.texts().collect()) == ["x y", "z"]  # the second batch's copy is not stored again
    (tmp_path / "artifacts" / "manifests" / f"{max(snaps.versions()):012d}.json").unlink()  # a version without its manifest is none
    assert {r.id: r.status for r in snaps.narrow().collect()}["8"] == "PROCESSING"


def test_a_task_delivered_twice_is_processed_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    snaps, calls = pending(spark, f"{root}/artifacts", ["1", "2", "3"]), []
    objects = lambda: calls.append(1) or spark.createDataFrame([("a.txt", b"x y")], "file_path string, content binary")
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "document_id string, file_path string, queued_at timestamp"
    for rows in ([("1", "a.txt", at(0))], [("1", "gone.txt", at(60)), ("2", "a.txt", at(60))], [("3", "a.txt", at(9000))], [("1", "gone.txt", at(9100))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{root}/queue")
        query = jobs.stream_process_documents(spark.readStream.schema(schema).json(f"{root}/queue"), objects, snaps, f"{root}/checkpoint", queued_at="queued_at", redelivery="10 minutes")
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        got = {r.id: r.status for r in snaps.narrow().collect()}
        if len(rows) == 2:
            assert got == {"1": "COMPLETED", "2": "COMPLETED", "3": "PENDING"}  # the repeated task, without an object, changed nothing
    assert got == {"1": "FAILED", "2": "COMPLETED", "3": "COMPLETED"}  # long after, it is a new task
    assert states[-1] <= 2  # the keys of the first minutes are forgotten
