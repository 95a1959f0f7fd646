"""Streams: the task queue, running statuses, new objects, and documents that got stuck."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dossier.functions import exprs
from dossier.operators.extract import decode_text, process_documents
from dossier.operators.mutate import apply_status_updates
from dossier.schemas import HARD_LIMIT_SECONDS
from dossier.sources.objects import ROCKSDB, stream_listed
from dossier.sources.snapshots import Snapshots


def delivered_once(queue: DataFrame, queued_at: str, redelivery: str, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """The tasks of a queue that may deliver one again: the first of each ``key`` within ``redelivery`` of its time ``queued_at``.

    Keys are forgotten once the watermark has passed them by that time, so that state stays bounded by the tasks of
    that while. A task that is queued anew later is a new one.
    """
    return queue.withWatermark(queued_at, redelivery).dropDuplicatesWithinWatermark(list(key))


def stream_process_documents(queue: DataFrame, objects: Callable[[], DataFrame], artifacts: Snapshots, checkpoint: str, extractors=None, queued_at: str | None = None, redelivery: str = "1 hour", key: tuple[str, ...] = ("document_id",), **trigger) -> StreamingQuery:
    """Processes tasks (document_id, file_path) as they come and saves statuses in new versions of the artifacts.

    Version 0 is the table before the stream. Batch n first merges version 2n + 1, in which its documents are
    PROCESSING, then extracts, and merges version 2n + 2 with the outcome; a merge rewrites the partitions of its
    documents only. Each is made from the last one before it, so that a batch that runs again gives the same; after a
    crash its documents stay PROCESSING until it does. With ``queued_at``, a column of the queue, a task that is
    delivered again is processed once (``delivered_once``).
    """

    def change(rows: DataFrame, updates: DataFrame) -> DataFrame:
        return apply_status_updates(rows, updates, F.current_timestamp())[0]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, begun, ended = batch.sparkSession, 2 * batch_id + 1, 2 * batch_id + 2
        folder = f"{artifacts.root}/tasks/{batch_id:012d}"
        batch.select("document_id", "file_path").dropDuplicates(["document_id"]).write.mode("overwrite").parquet(folder)
        tasks = spark.read.schema(batch.select("document_id", "file_path").schema).parquet(folder)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("extracted_text", "string"), ("page_count", "int"), ("word_count", "int"))]
        started = tasks.select(F.col("document_id").alias("id"), F.lit("PROCESSING").alias("status"), *nothing, F.lit(batch_id).alias("ts"))
        artifacts.merge(started, begun, change)
        done = process_documents(tasks, objects(), extractors)
        updates = done.select(F.col("document_id").alias("id"), "status", "extracted_text", "page_count", "word_count", F.lit(batch_id).alias("ts"))
        artifacts.merge(artifacts.put_texts(updates, ended), ended, change)

    if queued_at is not None:
        queue = delivered_once(queue, queued_at, redelivery, key)
    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_latest_status(log: DataFrame) -> DataFrame:
    """The running last status of each document of a log stream; for output mode complete or update."""
    last = log.groupBy("document_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last"))
    return last.select("document_id", "last.status", F.col("last.ts").alias("since"))


def stream_landing(spark: SparkSession, root: str) -> DataFrame:
    """New objects below ``root``: file_path, extension, length, and for text files their text's word_count."""
    rows = stream_listed(spark, root)
    text = F.when(exprs.file_kind(F.col("file_path")) == "txt", decode_text(F.col("content")))
    return rows.select("file_path", exprs.file_extension(F.col("file_path")).alias("extension"), "length", exprs.word_count(text).alias("word_count"))


class _Watch(StatefulProcessor):
    """Events of a document wait until the watermark has passed them, and are then followed in order."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, event_id long, status string")
        self.running = handle.getValueState("running", "since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(int(r.ts_us), r.event_id, r.status) for r in rows]
        self.held.appendList(new)
        self.handle.registerTimer(-(-min(ts for ts, _, _ in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get(), key=lambda e: (e[0], e[1] is not None, e[1] or 0)) if self.held.exists() else []
        ripe = [e for e in held if e[0] <= passed * 1000]
        since = self.running.get()[0] if self.running.exists() else None
        was, late = since, []
        for ts, _, status in ripe:
            if since is not None and (ts - since) // 1000 > self.limit:
                late.append(since)
            since = ts if status == "PROCESSING" else None
        if since is not None and since // 1000 + self.limit + 1 < passed:
            late.append(since)
            since = None
        if ripe and len(ripe) < len(held):
            self.held.put(held[len(ripe) :])
        elif ripe:
            self.held.clear()
        if len(ripe) < len(held):
            self.handle.registerTimer(max(-(-held[len(ripe)][0] // 1000), passed + 1))
        if since is not None:
            self.running.update((since,))
            self.handle.registerTimer(max(since // 1000 + self.limit + 1, passed + 1))
        elif was is not None:
            self.running.clear()
        return iter([Row(document_id=key[0], since_us=x) for x in late])

    def close(self) -> None:
        pass


def stream_stuck_documents(log: DataFrame, limit_seconds: int = HARD_LIMIT_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(document_id, since) of documents that stay PROCESSING for longer than the limit, in event time.

    A document's time runs from a PROCESSING event to the next event, whichever status that has. Events are held until
    the watermark passes them and then taken by (ts, event_id), so that within ``delay`` any order of arrival gives what
    ``stuck_documents`` gives; later ones are dropped. What the last events within the delay would end is told once the
    watermark has passed them, or by ``stuck_at_the_end``. State is the held events, and the start of running documents.
    It lies in RocksDB, which this sets for the session; output mode append.
    """
    spark, kind = log.sparkSession, log.schema["document_id"].dataType.simpleString()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = log.where("ts IS NOT NULL AND document_id IS NOT NULL").withWatermark("ts", delay).select("document_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"), "status")
    found = events.groupBy("document_id").transformWithState(_Watch(int(limit_seconds * 1000)), f"document_id {kind}, since_us long", "append", "eventTime")
    return found.select("document_id", F.timestamp_micros("since_us").alias("since"))


def stuck_at_the_end(spark: SparkSession, checkpoint: str, limit_seconds: int = HARD_LIMIT_SECONDS) -> DataFrame:
    """(document_id, since) that ``stream_stuck_documents`` has not told yet but would, if its input ends here.

    While a stream runs, an event within the delay may still be preceded by another one, so that a document that it ends
    after the limit is told later. Once all input has come, what the state in ``checkpoint`` holds is the whole order.
    """
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    held = state("held").select("key.document_id", "list_element.*")
    running = state("running").select("key.document_id", F.col("value.since").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit("PROCESSING").alias("status"))
    order = Window.partitionBy("document_id").orderBy("ts", "event_id")
    rows = held.unionByName(running).withColumn("later", F.lead("ts").over(order))
    stuck = rows.where((F.col("status") == "PROCESSING") & (F.expr("(later - ts) div 1000") > int(limit_seconds * 1000)))
    return stuck.select("document_id", F.timestamp_micros("ts").alias("since"))
