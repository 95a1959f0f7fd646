"""Versions of the artifacts at rest: hash partitions below a manifest, so that a change rewrites only the partitions it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Hash partitions of a new table. Small ones merge cheaply; a table of billions of rows wants thousands.
PARTITIONS = 64
#: Digits of a digest that name its text's folder: 16, 256 or 4096 folders for each version that brings texts.
TEXT_DIGITS = 2


class Snapshots:
    """Versions of a table below ``root``, numbered; the current one is the last whose manifest stands.

    A manifest names, for each hash partition of ``id``, the version that wrote it last. A version is therefore whole at
    once when its manifest is renamed into place, and shares all partitions that it did not touch with those before.
    Rows are narrow: in place of ``extracted_text`` they have the text's SHA-256. Each text is stored once, below the
    first digits of its digest. ``partitions`` counts for a new table, as a table keeps its own; ``text_digits`` has to be
    the same each time.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = PARTITIONS, text_digits: int = TEXT_DIGITS):
        self.spark, self.root, self.partitions, self.text_digits = spark, root.rstrip("/"), partitions, text_digits

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        store, path = self._store(), self._path(below)
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int) -> dict:
        """``partitions`` (their number), ``schema`` and ``written``: partition number to the version that wrote it."""
        stream = self._store().open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        store, aside, place = self._store(), self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        out = store.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if store.exists(place):
            store.delete(place, False)
        if not store.rename(aside, place):
            raise OSError(f"could not publish version {version}")

    def _write(self, rows: DataFrame, version: int) -> None:
        by = F.pmod(F.xxhash64("id"), F.lit(self.partitions)).cast("int")
        rows.withColumn("part", by).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/data/{version:012d}")

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/data/{v:012d}/part={p}" for p, v in manifest["written"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, version: int) -> None:
        """A whole table as a version of its own, texts and all."""
        narrow = self.put_texts(df, version)
        self._write(narrow, version)
        parts = [n.removeprefix("part=") for n in self._names(f"data/{version:012d}") if n.startswith("part=")]
        self._publish(version, {"partitions": self.partitions, "schema": narrow.schema.jsonValue(), "written": dict.fromkeys(parts, version)})

    def merge(self, updates: DataFrame, version: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Version ``version``: the last one before it with ``change(rows, updates)`` in place of the rows of touched partitions.

        Only partitions in which an update's ``id`` falls are read and written; the driver sees their numbers. A merge
        that runs again writes the same version again. ``updates`` is read more than once, so it must be a table that stays.
        """
        old = self.manifest(max(v for v in self.versions() if v < version))
        self.partitions = old["partitions"]
        by = F.pmod(F.xxhash64("id"), F.lit(self.partitions)).cast("int").alias("part")
        touched = {r.part for r in updates.where("id IS NOT NULL").select(by).distinct().collect()} & {int(p) for p in old["written"]}
        if touched:
            self._write(change(self._read(old, sorted(touched)), updates), version)
        self._publish(version, old | {"written": old["written"] | {str(p): version for p in touched}})

    def put_texts(self, rows: DataFrame, version: int) -> DataFrame:
        """Stores the texts of rows with ``extracted_text`` that are not there yet; gives the rows with digests, from a table of their own.

        Which texts are new is found out by digests alone, in the folders of these digests only.
        """
        digest = F.sha2(F.col("extracted_text").cast("binary"), 256)
        staged = f"{self.root}/staged/{version:012d}"
        rows.withColumn("text", F.col("extracted_text")).withColumn("extracted_text", digest).write.mode("overwrite").parquet(staged)
        full = self.spark.read.schema(StructType([*rows.schema.fields, StructField("text", StringType())])).parquet(staged)
        fresh = full.where("extracted_text IS NOT NULL").withColumn("bucket", F.substring("extracted_text", 1, self.text_digits))
        asked = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as there are folders at most
        known = self.texts(asked)
        if known is not None:
            fresh = fresh.join(known.select("extracted_text"), "extracted_text", "left_anti")
        fresh = fresh.select("extracted_text", "text", "bucket").dropDuplicates(["extracted_text"])
        # A task gets many small folders or a part of a large one.
        fresh.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/texts/{version:012d}")
        return full.select(*rows.columns)

    def texts(self, buckets: list[str] | None = None) -> DataFrame | None:
        """(extracted_text, text): digests and their texts, of these folders or of all."""
        store = self._store()
        paths = [f"{self.root}/texts/{v}" for v in self._names("texts") if store.exists(self._path(f"texts/{v}/_SUCCESS"))]
        if not paths:
            return None
        parts = [self.spark.read.schema("extracted_text string, text string, bucket string").parquet(p) for p in paths]  # a version without new texts has no folders
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).select("extracted_text", "text")

    def narrow(self, before: int | None = None) -> DataFrame:
        """The current version, or the last one before ``before``, with digests in place of texts."""
        return self._read(self.manifest(max(v for v in self.versions() if before is None or v < before)))

    def read(self, before: int | None = None) -> DataFrame:
        """The same with the texts, each found by its digest."""
        table, texts = self.narrow(before), self.texts()
        if texts is None:
            return table
        found = table.join(texts, "extracted_text", "left")
        return found.select(*(F.col("text").alias(c) if c == "extracted_text" else c for c in table.columns))
