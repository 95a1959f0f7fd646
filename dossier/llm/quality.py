"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed
rule, so that policies (sets of rules, by version) and ablations are bitwise work on a narrow table, without the
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import Words, hash_ranges, mix64, pieces, windows_hash

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: Rules by bit: name and the condition under which a document fails. All arithmetic is on whole numbers.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("upper_case", "n_letters >= 20 AND 100 * n_upper > 60 * n_letters"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars > 20 * n_words"),
)

#: Policies by version: the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "upper_case", "duplicate_lines", "word_length"),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _measure(texts: pa.Array, window: int) -> list[np.ndarray]:
    w = Words(texts)
    docs = len(w.count)
    if not len(w.data):
        return [np.zeros(docs, dtype=np.int64)] * len(MEASURES)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[w.offsets])

    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    characters = (w.data & 0xC0) != 0x80
    upper = (w.data >= 0x41) & (w.data <= 0x5A)
    lower = (w.data >= 0x61) & (w.data <= 0x7A)

    # Lines with a word: from a text's begin or a line end to the next.
    breaks = np.flatnonzero(w.data == 0x0A)
    begin = np.union1d(w.offsets[:-1], breaks + 1)
    begin = begin[begin < len(w.data)]
    stop = np.minimum(np.append(begin[1:], len(w.data)), len(w.data))
    stop = stop - (w.data[np.maximum(stop - 1, 0)] == 0x0A) * (stop > begin)
    full = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(w.offsets, begin, "right") - 1
    key = mix64(hash_ranges(w.data, begin, stop) + mix64(line_doc))
    lines = np.bincount(line_doc, minlength=docs)
    _, one = np.unique(key, return_index=True)
    dup = lines - np.bincount(line_doc[one], minlength=docs)

    # Words in windows that occur again in the same text.
    doc, repeated = w.doc(), np.zeros(docs, dtype=np.int64)
    if len(doc) >= window:
        own = doc[: len(doc) - window + 1] == doc[window - 1 :]
        at = np.flatnonzero(own)
        key = mix64(windows_hash(w.hashes(), window)[at] + mix64(doc[at]))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(doc) + 1, dtype=np.int64)
        cover[at[twice]] += 1
        cover[at[twice] + window] -= 1
        repeated = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=docs)
    return [w.count, per_doc(characters & (np.cumsum(inside)[:-1] > 0)), per_doc(_SYMBOL[w.data]), dup, repeated, lines, per_doc(upper | lower), per_doc(upper)]


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """One row for each document: doc_id, the measurements (long) and ``failed`` (long, bit k for rule k).

    A null text is empty: zero words, which fails ``few_words``. Rows with equal or null ids are judged one by
    one. An empty table gives an empty ledger; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = _measure(piece.column("text"), window)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, type=pa.int64()) for x in found)], names=["doc_id", *MEASURES])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.mapInArrow(run, schema).withColumn("failed", failed)


def mask_of(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def apply_policy(ledger: DataFrame, policy: str = "v1", into: str = "kept") -> DataFrame:
    """Adds a boolean column: no rule of the policy failed."""
    return ledger.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that fail it alone (kept without it), and that the policy keeps."""
    mask = mask_of(policy)
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    names = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    sums = [F.count_if(hit.bitwiseAND(F.lit(1 << k)) != 0).alias(f"f{k}") for k, _ in names] + [F.count_if(hit == F.lit(1 << k)).alias(f"o{k}") for k, _ in names]
    one = ledger.agg(F.count_if(hit == 0).alias("kept"), *sums)
    stack = ", ".join(f"'{name}', f{k}, o{k}" for k, name in names)
    return one.select("kept", F.expr(f"stack({len(names)}, {stack}) AS (rule, failed, failed_alone)")).select("rule", "failed", "failed_alone", "kept")
