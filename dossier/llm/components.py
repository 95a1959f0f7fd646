"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from dossier.llm.shared import removed, shared_path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node it reaches.

    A round has four shuffles. Each edge (u, v), u > v, is first moved to the smallest neighbour of v: an
    aggregate, then a join that adaptive execution splits where a v has very many edges. Then each u keeps its
    smallest v and links the others to that. Rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder and then the one before is deleted; how many edges it has and the sum of their
    hashes are observed while it is written, and it is the last if they did not change. Loops, nulls and repeated edges are ignored.
    """
    spark = edges.sparkSession
    e, mark, path = _round(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while mark[0]:
        before, last = mark, path
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("v"), F.least("x", "low").alias("m"))
        # Both sides grow with the edges, so neither is ever broadcast.
        large = e.join(low.hint("merge"), "v").select("u", "m")
        least = F.min("m").over(Window.partitionBy("u"))
        moved = large.select("u", "m", least.alias("v"))
        pairs = F.array(F.struct("u", "v"), F.struct(F.col("m").alias("u"), "v"))
        e, mark, path = _round(moved.select(F.explode(F.filter(pairs, lambda p: p["u"] != p["v"])).alias("p")).select("p.u", "p.v").distinct())
        removed(spark, last)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _round(e: DataFrame) -> tuple[DataFrame, tuple, str]:
    """The edges, written and read again, with their number, the sum of their hashes and where they are."""
    spark, seen, path = e.sparkSession, Observation(), shared_path(e.sparkSession, "edges")
    e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).write.parquet(path)
    return spark.read.schema(e.schema).parquet(path), (seen.get["n"], seen.get["sum"]), path
