"""The entity tables at rest: Parquet with declared types, new snapshots beside old ones. ``dossier.sources.database`` has them in a database."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.schemas import SCHEMAS


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local one in local mode only; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-dossier-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/dossier-{uuid.uuid4().hex}"


def create_tables(spark: SparkSession, root: str) -> None:
    """Writes an empty table for each entity that has none yet."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Writes with the entity's columns and types, in order; a missing nullable column is null."""
    fields = SCHEMAS[name].fields
    missing = [f.name for f in fields if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.mode(mode).parquet(f"{root}/{name}")


def write_bucketed(df: DataFrame, table: str, column: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """The table ``table`` of the catalog, dealt by ``column`` into ``buckets`` files that are sorted by it.

    Tables dealt alike (such as evidence by its id and mappings by theirs) are joined bucket by bucket, without a
    shuffle, as often as they are read. Rows are dealt once here, so that each bucket is one file. Buckets should hold
    some hundred megabytes each.
    """
    writer = df.repartition(buckets, column).write.mode("overwrite").format("parquet").bucketBy(buckets, column).sortBy(column)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
