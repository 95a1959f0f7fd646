"""Obligations and requirement codes in extracted texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that make a sentence an obligation.
OBLIGATION_TERMS = r"(?i)\b(must not|must|shall not|shall|is required to|are required to|should)\b"
#: A code at the start of a line, then its title.
CODE_LINE = r"^((?:Art\.|Article|Section|§)\s?\d+[a-z]?(?:\.\d+)*|[A-Z]{1,4}\d+(?:\.\d+)*)[\s:.\-]+(.*)$"


#: Most terms of a list, and most characters of them all: the automaton goes to every task.
MOST_TERMS, MOST_TERM_CHARS = 1_000_000, 32 << 20


def extract_obligations(docs: DataFrame, terms: str | Sequence[str] = OBLIGATION_TERMS, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """One row for each sentence with a term: document_id, seq (from 0, over all sentences), sentence, term.

    Sentences end at ``.``, ``!`` or ``?`` with white space behind, and at line ends; what ends them is no part of
    them. Null texts have none. ``terms`` is a pattern, or a list of words and phrases, which may be very long: these are
    found by an automaton in one pass, as whole words and whatever the case of A-Z; of several the first in the sentence
    is given, and of those that start together the first in the list, as a pattern of alternatives would.
    """
    parts = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, r"[.!?]\s+|\n")).alias("seq", "sentence"))
    if not isinstance(terms, str):
        return _with_terms(parts, list(terms))
    return parts.where(F.col("sentence").rlike(terms)).withColumn("term", F.regexp_extract("sentence", terms, 0))


def _lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode().lower().decode()


def _with_terms(sentences: DataFrame, terms: list[str]) -> DataFrame:
    if len(terms) > MOST_TERMS or sum(map(len, terms)) > MOST_TERM_CHARS:
        raise ValueError(f"at most {MOST_TERMS} terms of {MOST_TERM_CHARS} characters in all")
    shared = sentences.sparkSession.sparkContext.broadcast(terms)
    known: list = []  # the automaton, made once in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not known:
            made = ahocorasick.Automaton()
            for rank, term in reversed(list(enumerate(shared.value))):
                if term:
                    made.add_word(_lower(term), (rank, len(term)))  # of equal terms the first stands
            if len(made):
                made.make_automaton()
            known.append(made)
        (automaton,) = known
        for batch in batches:
            found = [first_term(s, automaton) if s and len(automaton) else None for s in batch.column("sentence").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "term"])

    return sentences.mapInArrow(run, sentences.schema.simpleString()[7:-1] + ",term:string").where("term IS NOT NULL")


def first_term(sentence: str, automaton) -> str | None:
    """The first term that stands between word bounds: the leftmost start, then the smallest rank."""
    word = lambda i: 0 <= i < len(sentence) and (sentence[i].isalnum() or sentence[i] == "_")
    best = None
    for last, (rank, size) in automaton.iter(_lower(sentence)):
        start = last - size + 1
        if (best is None or (start, rank) < best[:2]) and word(start - 1) != word(start) and word(last) != word(last + 1):
            best = (start, rank, size)
    return best and sentence[best[0] : best[0] + best[2]]


def extract_requirement_codes(docs: DataFrame, pattern: str = CODE_LINE, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """One row for each line that starts with a code: document_id, seq (from 0, over all lines), code, title."""
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, "\n")).alias("seq", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("document_id", "seq", F.regexp_extract("line", pattern, 1).alias("code"), F.regexp_extract("line", pattern, 2).alias("title"))
