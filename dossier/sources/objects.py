"""Objects of a bucket or folder, as rows and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


#: What opening an object counts for when Spark deals objects to tasks, in bytes; its default of 4 MB gives a task 32 small ones.
OPEN_BYTES = 64 << 10

#: Where a stream keeps its state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Objects that one batch of a stream takes; the driver keeps the paths of one batch as a plan.
BATCH_OBJECTS = 100_000


def deal_objects(spark: SparkSession) -> None:
    """Lets tasks take thousands of small objects, and a stream list a batch in some tasks for each core instead of up to 10,000.

    Two settings of the session; what it sets itself stays.
    """
    for name, value in (("spark.sql.files.openCostInBytes", OPEN_BYTES), ("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def object_key(path: Column, root: str) -> Column:
    """The part of a path below the root."""
    from urllib.parse import urlparse

    below = urlparse(root).path.rstrip("/") + "/"
    return F.regexp_extract(path, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in below) + "(.*)$", 1)


#: Bytes of contents that a task's Python hands over at once (a larger object goes alone), and keys that it lists at once.
CONTENT_BYTES = 4 << 20
LISTED_KEYS = 10_000

LISTED = "file_path string, length long, modified_us long"


def _listed(seed: DataFrame, root: str) -> DataFrame:
    """file_path, length and modified of the objects below ``root``, listed once for each row of ``seed``, which says nothing else.

    One task lists the folder itself; what lies in it is dealt to tasks, which walk through its folders, one at a time. No
    keys come to the driver. Hidden names (``_`` and ``.`` in front) are left out, as Spark's own sources do.
    """
    spark = seed.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def walk(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            kinds = pa.schema([("file_path", pa.string()), ("length", pa.int64()), ("modified_us", pa.int64())])
            store, base = fs.FileSystem.from_uri(root)
            for batch in batches:
                is_object = pc.is_valid(batch.column("length"))
                yield pa.RecordBatch.from_arrays(batch.filter(is_object).columns, schema=kinds)
                todo = batch.filter(pc.invert(is_object)).column("file_path").to_pylist()
                while todo:
                    below = todo.pop()
                    entries = store.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/")))
                    seen = [e for e in entries if not (e.base_name[0] == "." or e.base_name[0] == "_" and "=" not in e.base_name or e.base_name.endswith("._COPYING_"))]
                    rows = [(f"{below}{e.base_name}", e.size, e.mtime_ns // 1000) for e in seen if e.type == fs.FileType.File]
                    folders = [f"{below}{e.base_name}/" for e in seen if e.type == fs.FileType.Directory]
                    if deep:
                        todo += folders
                    else:
                        rows += [(f, None, None) for f in folders]
                    for k in range(0, len(rows), LISTED_KEYS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + LISTED_KEYS]), kinds.types)], schema=kinds)

        return run

    rows = seed.select(F.lit("").alias("file_path"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("modified_us"))
    rows = rows.mapInArrow(walk(False), LISTED).repartition(parts, "file_path")  # by name, so that a task that runs again deals alike
    return rows.mapInArrow(walk(True), LISTED).select("file_path", "length", F.timestamp_micros("modified_us").alias("modified"))


def _contents(root: str):
    """The column of contents of the objects below ``root``, by their keys; they are read where it is asked for, and only then."""

    @F.arrow_udf("binary")
    def content(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in keys:
            found, size = [], 0
            for key in batch.to_pylist():
                with store.open_input_stream(f"{base}/{key}", compression=None) as f:
                    found.append(f.read())
                size += len(found[-1])
                if size >= CONTENT_BYTES:
                    yield pa.array(found, pa.binary())
                    found, size = [], 0
            if found:
                yield pa.array(found, pa.binary())

    return content


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """file_path, length and modified of every object below ``root``, listed by tasks."""
    return _listed(spark.range(0, 1, 1, 1), root)


def read_listed(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """What ``read_objects`` gives, for buckets of any number of objects: keys are listed by tasks and stay there, and objects without bytes count too.

    ``root`` is a folder that Arrow's file systems know (local, HDFS, S3, GCS).
    """
    rows = list_objects(spark, root)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "file_path").select("file_path", _contents(root)("file_path").alias("content"), "length", "modified")


def stream_listed(spark: SparkSession, root: str) -> DataFrame:
    """The same, as a stream of new objects: each trigger lists the bucket, and keys that were seen before are dropped.

    Seen keys are the stream's state, dealt over the executors (in RocksDB, which this sets for the session); the driver knows
    none. A key that is written again is not new. A listing goes through the whole bucket: give the stream an interval.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    rows = _listed(ticks, root).dropDuplicates(["file_path"])
    return rows.select("file_path", _contents(root)("file_path").alias("content"), "length", "modified")


def read_objects(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """file_path, content, length and modified of every object below ``root``; larger ones are left out by ``max_bytes`` before they are read.

    Folders below one are listed in parallel where there are over 32; objects of one folder are listed by one task. Spark's source
    keeps all paths on the driver and leaves out objects of zero bytes; ``read_listed`` does neither.
    """
    deal_objects(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    return rows.select(object_key(F.col("path"), root).alias("file_path"), "content", "length", F.col("modificationTime").alias("modified"))


def write_objects(objects: DataFrame, root: str) -> DataFrame:
    """Puts objects (file_path, content) below ``root``, each as a file of its own; one row for each: file_path, length.

    A key that exists is overwritten; of rows with one key any may be the last, so fold them before
    (``land_objects``). Rows with a null key or content are left out. Files are written aside and renamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for key, content in zip(batch.column("file_path").to_pylist(), batch.column("content"), strict=True):
                where = f"{base}/{key}"
                folder = os.path.dirname(where)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                aside = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(aside, compression=None) as out:
                    out.write(content.as_buffer())
                try:
                    store.move(aside, where)
                except OSError:  # not every store replaces on a move
                    if store.get_file_info(where).type != fs.FileType.File:
                        raise
                    store.delete_file(where)
                    store.move(aside, where)
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pc.binary_length(batch.column("content")).cast(pa.int64())], names=["file_path", "length"])

    rows = objects.where("file_path IS NOT NULL AND content IS NOT NULL").select("file_path", "content")
    return rows.mapInArrow(run, "file_path string, length long")


def stream_objects(spark: SparkSession, root: str, batch: int = BATCH_OBJECTS) -> DataFrame:
    """What ``read_objects`` gives, as a stream of new objects, ``batch`` of them at a time. All paths that were seen lie on the driver (see ``stream_listed``)."""
    deal_objects(spark)
    rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch).load(root)
    return rows.select(object_key(F.col("path"), root).alias("file_path"), "content", "length", F.col("modificationTime").alias("modified"))
