"""The corpus pipeline: stages that each call one operator and hand their rows to the next.

All but the last return the columns of ``documents``. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import langid, secrets
from dossier.llm.decontam import drop_leaking
from dossier.llm.mixing import mix_sources
from dossier.llm.neardup import near_duplicates
from dossier.llm.shared import written

#: A document stays if at least this share of its letters is in its main language.
MAIN_LANGUAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (or text) and those without a main language. ``lang`` stays as it is."""
    model = langid.train(docs)
    found = langid.identify_languages(docs, model, carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("share") >= MAIN_LANGUAGE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each component, that with the smallest id (null ids last), and every row without words.

    Rows are numbered in a copy in the shared folder, so that the number stays when a task runs again.
    """
    number = "_" * max(map(len, docs.columns)) + "_row"  # longer than any column, so that it has no namesake
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    gone = near_duplicates(rows, row_col=number).where(~F.col("kept")).select(number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live secrets in the texts; all documents stay, and n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies and taken, of documents taken at least once."""
    return mix_sources(docs).where(F.col("copies") > 0)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: The stages' methods have no SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
