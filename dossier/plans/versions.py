"""Versions of frameworks: which one holds at a date, what changed, and what a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_as_of(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """For each asked (framework_id, as_of): the active version published last on or before that date.

    Versions without a date are never chosen; of equal dates the greatest slug, then the greatest id. Without
    any the version is null. Dates and versions are merged in one order by framework and each date takes the last version
    before it: rows are those asked and the versions, never their pairs.
    """
    no = lambda c: F.lit(None).cast(versions.schema[c].dataType)
    keys = asked.select("framework_id", "as_of").distinct().select("framework_id", F.col("as_of").alias("at"), F.lit(1).alias("asked"), no("id").alias("version_id"), no("version_slug").alias("version_slug"), no("publication_date").alias("publication_date"))
    usable = versions.where("is_active AND publication_date IS NOT NULL AND framework_id IS NOT NULL").select(F.col("framework_id").cast(asked.schema["framework_id"].dataType).alias("framework_id"), F.col("publication_date").cast(asked.schema["as_of"].dataType).alias("at"), F.lit(0).alias("asked"), F.col("id").alias("version_id"), "version_slug", "publication_date")
    w = Window.partitionBy("framework_id").orderBy("at", "asked", "version_slug", "version_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("asked") == 0, F.struct("version_id", "version_slug", "publication_date")), ignorenulls=True).over(w)
    return keys.unionByName(usable).withColumn("v", held).where("asked = 1").select("framework_id", F.col("at").alias("as_of"), "v.version_id", "v.version_slug", "v.publication_date")


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """(framework_id, old_version_id, new_version_id) of versions that follow one another by date (nulls first), slug and id."""
    w = Window.partitionBy("framework_id").orderBy("publication_date", "version_slug", "id")
    return versions.select("framework_id", F.col("id").alias("old_version_id"), F.lead("id").over(w).alias("new_version_id")).where("new_version_id IS NOT NULL")


def version_diff(requirements: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair and code: added, removed, modified (title or description differ) or unchanged, with both requirement ids."""
    def side(which: str) -> DataFrame:
        rows = requirements.join(pairs.select("old_version_id", "new_version_id"), F.col("version_id") == F.col(f"{which}_version_id"))
        return rows.select("old_version_id", "new_version_id", "code", F.col("id").alias(f"{which}_id"), F.col("title").alias(f"{which}_title"), F.col("description").alias(f"{which}_description"))

    both = side("old").join(side("new"), ["old_version_id", "new_version_id", "code"], "full")
    same = F.col("old_title").eqNullSafe(F.col("new_title")) & F.col("old_description").eqNullSafe(F.col("new_description"))
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select("old_version_id", "new_version_id", "code", change.alias("change"), "old_id", "new_id")


def change_impact(diff: DataFrame, mappings: DataFrame) -> DataFrame:
    """By pair, change (removed or modified) and organization: touched requirements, mappings and evidence."""
    changed = diff.where("change IN ('removed', 'modified')").select("old_version_id", "new_version_id", "change", F.col("old_id").alias("requirement_id"))
    rows = mappings.join(changed, "requirement_id")
    return rows.groupBy("old_version_id", "new_version_id", "change", "organization_id").agg(F.count_distinct("requirement_id").alias("requirements"), F.count("*").alias("mappings"), F.count_distinct("evidence_id").alias("evidence"))


def carry_forward(diff: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings proposed for the new version: unchanged codes keep their status, modified ones become pending, removed ones go."""
    kept = diff.where("change IN ('unchanged', 'modified')").select("old_version_id", "new_version_id", "change", F.col("old_id").alias("requirement_id"), "new_id")
    rows = mappings.join(kept, "requirement_id")
    status = F.when(F.col("change") == "modified", "pending").otherwise(F.col("status"))
    return rows.select("old_version_id", "new_version_id", "organization_id", "evidence_id", F.col("new_id").alias("requirement_id"), "similarity_score", status.alias("status"))
