"""Text extraction: from stored objects to texts and counts, one bad file never failing the rest."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import exprs

#: An extractor gives the parts of a file (pages or paragraphs) and its page count.
Extractor = Callable[[bytes], tuple[list[str], int]]


def pdf_parts(content: bytes) -> tuple[list[str], int]:
    """Texts of the pages that have any, and the number of all pages. Needs a PDF library on the executors."""
    import io

    import pypdf

    pages = [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages]
    return [p for p in pages if p], len(pages)


def docx_parts(content: bytes) -> tuple[list[str], int]:
    """Texts of all paragraphs; such files have no page count, so 1. Needs a DOCX library on the executors."""
    import io

    import docx

    return [p.text for p in docx.Document(io.BytesIO(content)).paragraphs], 1


EXTRACTORS: dict[str, Extractor] = {"pdf": pdf_parts, "docx": docx_parts}


#: A character for private use, to write out characters that would be lost otherwise.
_ESCAPE, _REPLACEMENT = "\ue000", "\ufffd"


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes with malformed ones left out; a byte order mark stays.

    Spark puts U+FFFD for what is malformed. Those that the bytes really have are written as an escape meanwhile.
    """
    text, e, r = content.cast("string"), F.lit(_ESCAPE), F.lit(_REPLACEMENT)
    kept = F.replace(F.replace(text, e, F.lit(_ESCAPE + "0")), r, F.lit(_ESCAPE + "1"))
    good = F.replace(F.make_valid_utf8(kept), r, F.lit(""))
    back = F.replace(F.replace(good, F.lit(_ESCAPE + "1"), r), F.lit(_ESCAPE + "0"), e)
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """document_id, text (pages that have text, by page_no, a line each) and page_count (all pages), from (document_id, page_no, page_text)."""
    parts = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t"))))
    rows = pages.groupBy("document_id").agg(parts.alias("p"), F.count("*").alias("page_count"))
    full = F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != "")
    return rows.select("document_id", F.array_join(full, "\n").alias("text"), "page_count")


def assemble_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """document_id, text (all paragraphs in order, empty ones too) and page_count 1."""
    parts = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t"))))
    rows = paragraphs.groupBy("document_id").agg(parts.alias("p"))
    return rows.select("document_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"), F.lit(1).cast("bigint").alias("page_count"))


#: Bytes of files that go to Python at once (a larger file goes alone).
BATCH_BYTES = 64 << 20


def process_documents(tasks: DataFrame, objects: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """One row for each task (document_id, file_path): status COMPLETED with extracted_text, page_count and word_count, or FAILED with error.

    Objects are (file_path, content). A missing object, an unknown kind, an absent library and an extractor that
    raises fail that task alone. Missing objects are found by keys only. Contents are read once, and only of asked
    objects of a known kind: tasks join them as the side that Spark can broadcast, so that contents stay where they
    are read. Texts are decoded by Spark and never leave it; the contents of other kinds alone go to their extractor,
    file by file, in batches of ``BATCH_BYTES`` (set for the session where it has no bound).
    """
    extractors = EXTRACTORS if extractors is None else extractors
    conf, bound = tasks.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(bound, str(2**31 - 1)).rstrip("b")) > BATCH_BYTES:
        conf.set(bound, str(BATCH_BYTES))
    asked = tasks.select("document_id", "file_path").withColumn("kind", exprs.file_kind(F.coalesce("file_path", F.lit(""))))
    keys = objects.select("file_path").distinct().withColumn("there", F.lit(True))
    name = F.coalesce("file_path", F.lit(""))
    checked = asked.join(keys, "file_path", "left")
    error = F.when(F.col("there").isNull(), F.concat(F.lit("No object with key: "), name)).otherwise(exprs.kind_error(name))
    failed = checked.withColumn("error", error).where("error IS NOT NULL")
    failed = failed.select("document_id", "file_path", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("extracted_text"), F.lit(None).cast("int").alias("page_count"), "error")
    ready = objects.select("file_path", "content").where(exprs.file_kind(F.col("file_path")).isNotNull()).join(asked, "file_path")

    @F.pandas_udf("text string, pages int, error string")
    def extracted(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, content in zip(kinds, contents, strict=True):
            if kind is None:
                rows.append((None, None, None))
                continue
            try:
                parts, pages = extractors[kind](bytes(content))
                rows.append(("\n".join(parts), pages, None))
            except Exception as problem:
                rows.append((None, None, str(problem)))
        return pd.DataFrame(rows, columns=["text", "pages", "error"]).astype({"pages": "Int32"})

    is_text = F.col("kind") == "txt"
    other = lambda c: F.when(~is_text, F.col(c))
    made = ready.withColumn("made", extracted(other("kind"), other("content")))
    done = made.select(
        "document_id", "file_path", F.when(F.col("made.error").isNull(), "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(is_text, decode_text(F.col("content"))).otherwise(F.col("made.text")).alias("extracted_text"),
        F.when(is_text, 1).otherwise(F.col("made.pages")).alias("page_count"), F.col("made.error").alias("error"),
    )
    return done.unionByName(failed).withColumn("word_count", exprs.word_count(F.col("extracted_text")).cast("int"))


def process_result(processed: DataFrame) -> DataFrame:
    """What a task reports: counts and text_length when COMPLETED, the error when FAILED."""
    done = F.col("status") == "COMPLETED"
    return processed.select("document_id", "status", F.when(done, F.col("page_count")).alias("page_count"), F.when(done, F.col("word_count")).alias("word_count"), F.when(done, exprs.text_length(F.col("extracted_text"))).alias("text_length"), F.when(~done, F.col("error")).alias("error"))
