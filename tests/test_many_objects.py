"""Very many small objects: few tasks read them, and batches of a stream are bounded."""

import pytest
from dossier.sources.objects import read_objects, stream_objects, write_objects
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def bucket(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('bucket')}"
    rows = spark.range(1, 301, 1, 4).select(F.concat((F.col("id") % 40).cast("string"), F.lit("/o"), F.col("id").cast("string"), F.lit(".txt")).alias("file_path"), F.encode(F.repeat(F.lit("a b "), F.col("id").cast("int")), "UTF-8").alias("content"))
    for _ in range(2):  # the second time over what exists
        assert write_objects(rows, root).agg(F.sum("length")).first()[0] == 4 * 301 * 150
    return root


def test_few_tasks_read_small_objects(spark, bucket):
    rows = read_objects(spark, bucket)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert rows.select("file_path").distinct().count() == 300 and rows.agg(F.sum("length")).first()[0] == 4 * 301 * 150


def test_a_stream_takes_bounded_batches(spark, bucket, tmp_path):
    seen = {}
    stream = stream_objects(spark, bucket, batch=128)
    stream.writeStream.foreachBatch(lambda b, k: seen.__setitem__(k, {r.file_path for r in b.select("file_path").collect()})).trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start().awaitTermination()
    assert sorted(map(len, seen.values())) == [44, 128, 128] and len(set.union(*seen.values())) == 300
