"""Mixing of sources to target weights (DataFrame functions only).

Method: hash-threshold histograms. Each document gets a hash of its id. The sizes are summed by source and
bucket of leading hash bits; running sums over the at most ``2**bits`` buckets of a source find the bucket in
which its budget ends. Only the documents of that one bucket are summed again by the next bits, ``levels``
times. What is left is a threshold for each source, and documents are taken by comparing their hash with it:
nothing is sorted, and the same documents are taken on every run. Thresholds are nested: a source that is
repeated takes all its documents first, then those under the threshold once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import word_count, written

#: Bits of the hash in all: 15 hexadecimal digits of an MD5.
HASH_BITS = 60


def hash_of(id_col: str, text_col: str) -> F.Column:
    """60 bits of the id's MD5 (of the text's for a null id), which any SQL engine can compute."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def target_sizes(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeat: int) -> DataFrame:
    """Adds ``target`` to a table of one row for each source (skey, source, source_size).

    Weights go to the sources by code point, null last, repeating. The targets share ``share`` times all sizes
    by weight; one stops at ``max_repeat`` times its source's size and what it leaves is shared again. That ends
    at min(cap, level * weight) with one level for all sources, found by running sums over cap / weight.
    The windows here run over one row for each source, in one task.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    table = sources.withColumn("pos", F.row_number().over(everything)).withColumn("weight", w)
    table = table.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    table = table.withColumns({"ratio": F.col("cap") / F.col("weight"), "total": F.sum("source_size").over(whole) * F.lit(float(share)), "all_weight": F.sum("weight").over(whole), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "capped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "rank": F.row_number().over(by_ratio)})
    level = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    table = table.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole)["level"]
    return table.withColumn("target", F.coalesce(F.least("cap", fits * F.col("weight")), F.col("cap"))).select("skey", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = 3, bits: int = 10) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0) and ``taken`` is size times ``copies`` (0 to ``max_repeat``).
    A null source is a source of its own, last in order. Documents with one id (and null ids with one text)
    have one hash, so they are taken together. An empty table gives an empty result; other columns are ignored.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), skey.alias("skey"), hash_of(id_col, text_col).alias("h"), word_count(F.col(text_col)).alias("size"))
    rows = written(rows, "mix-sizes")
    sources = rows.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    plan = target_sizes(sources, weights, share, max_repeat)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("full", full).withColumn("budget", F.col("target") - F.col("source_size") * F.col("full"))
    plan = written(plan, "mix-targets")  # one row for each source

    left, inside, cut, shift = plan.select("skey", "budget", F.lit(0).cast("long").alias("prefix")), rows, None, HASH_BITS
    for level in range(levels):
        shift -= bits
        if level:
            inside = rows.join(left.select("skey", "prefix"), "skey").where(F.shiftright("h", shift + bits) == F.col("prefix")).select("skey", "h", "size")
        sums = inside.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        run = Window.partitionBy("skey").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("in_bucket").over(run)).join(left.select("skey", "budget"), "skey")
        edge = sums.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("in_bucket") <= F.col("budget")))
        left = edge.select("skey", (F.col("budget") - (F.col("upto") - F.col("in_bucket"))).alias("budget"), F.col("bucket").alias("prefix"), "in_bucket")
        left = written(left, "mix-boundary")  # at most one row for each source
    # The last bucket is taken if that comes nearer to the budget.
    cut = left.select("skey", (F.col("prefix") + (F.col("in_bucket") < 2 * F.col("budget")).cast("long")).alias("cut"))
    limits = plan.join(cut, "skey", "left").select("skey", "source_size", "target", "full", F.coalesce("cut", F.lit(0)).alias("cut"))
    copies = F.least(F.lit(max_repeat), F.col("full") + (F.shiftright("h", shift) < F.col("cut")).cast("int"))
    return rows.join(limits, "skey").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
