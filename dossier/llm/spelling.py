"""Spelling variants: words of a corpus that are one edit apart, found by asymmetric q-chunks, and the form each goes back to.

A word is cut into two disjoint chunks; one edit leaves one of them whole. The other word, as long or one longer, gives
its positional grams of the chunks' sizes. A chunk and a gram join if they are the same text and the gram's place is the
chunk's or the next one, and the pair is then verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dossier.llm.shared import Scratch, pieces, written

#: Words are runs of these letters, in lower case for A-Z only.
LETTERS = "A-Za-zÀ-ÿ"
#: Least code points and least occurrences of a word, and how much more frequent than a word its form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Chunks times grams of a key beyond which its words are compared by longer chunks.
DENSE = 1024
#: Letters that a comparison goes through at most; beyond, longer chunks come first.
WINDOW = 64
#: Words, and their bytes, that a task counts before it hands the counts on.
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, misspell: int | None = None) -> DataFrame:
    """(word, n) of the words of whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    With ``misspell``, runs lose a code point for trial: let h be the crc32 of ``<id>:<run>``; where ``misspell``
    divides h, the code point at h modulo the run's length goes. Runs of a null id keep all. Null texts have no words.
    Words are counted in the tasks before the shuffle, so that a frequent one is a row for each task.
    """
    run_of = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            size = 0
            return out

        for batch in pieces(batches, "text"):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if not text.is_valid:
                    continue
                head = None if key is None or misspell is None else zlib.crc32(f"{key}:".encode())
                for run, k in _runs(run_of, text.as_py()).items():
                    word = run.encode().lower()  # of bytes: A-Z only
                    if head is not None and (h := zlib.crc32(word, head)) % misspell == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) == min_length:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    size += 0 if word in counts else len(word)
                    counts[word] += k
                if len(counts) > HELD_WORDS or size > HELD_BYTES:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _runs(run_of: re.Pattern, text: str) -> Counter[str]:
    """Counts of a text's runs, one by one in a very long text."""
    return Counter(run_of.findall(text) if len(text) < 1 << 20 else (m.group() for m in run_of.finditer(text)))


def _halves(low: Column, high: Column, extra: Column) -> Column:
    """What one edit may have touched if the first half of the letters ``low:high`` is whole, and if the second is."""
    middle = low + F.floor((high - low) / 2).cast("int")
    part = lambda a, b: F.struct(extra.alias("extra"), a.alias("low"), b.alias("high"))
    return F.array(part(middle, high), part(low, middle))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, gram, part) with the key under which a chunk meets a gram: length, place and text of all that is whole.

    ``part`` has the letters ``low:high`` of the shorter word that the edit may have touched; what stands before them is
    at its own place in the longer word, and what stands behind them ``extra`` (0 or 1) further on.
    """
    extra, low = F.col("part.extra"), F.col("part.low")
    after = F.col("part.high") + F.when(F.col("gram"), extra).otherwise(0)
    length = F.char_length("word") + F.when(F.col("gram"), 0).otherwise(extra)
    whole = F.expr("left(word, part.low)"), F.substr("word", after + 1)
    return rows.withColumn("key", F.xxhash64(length, extra, low, F.col("part.high"), *whole))


def _chunks_and_grams(words: DataFrame) -> DataFrame:
    """Every word with its two chunks (for partners as long, and one longer) and with its grams (for partners as long, and one shorter)."""
    size, no, one = F.char_length("word"), F.lit(0), F.lit(1)
    chunks = F.concat(_halves(no, size, no), _halves(no, size, one))
    grams = F.concat(_halves(no, size, no), F.when(size > 1, _halves(no, size - 1, one)).otherwise(F.array().cast("array<struct<extra:int,low:int,high:int>>")))
    sides = [words.select("word", "n", F.lit(gram).alias("gram"), F.explode(parts).alias("part")) for gram, parts in ((False, chunks), (True, grams))]
    return _keyed(sides[0].unionByName(sides[1]))


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of rows under one key that are one edit apart, both ways; pairs of one length come twice."""
    low, high, extra = (F.col(f"part.{c}") for c in ("low", "high", "extra"))
    open_part = F.substr("word", low + 1, high - low + F.when(F.col("gram"), extra).otherwise(0))
    before, after = F.expr("left(word, part.low)"), F.substr("word", high + 1 + F.when(F.col("gram"), extra).otherwise(0))
    rows = rows.select("key", "gram", "word", "n", extra.alias("extra"), open_part.alias("open"), before.alias("before"), after.alias("after"))
    chunk = rows.where("NOT gram").select("key", "extra", "word", "n", "open", "before", "after")
    gram = rows.where("gram").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("open").alias("other_open"), F.col("before").alias("other_before"), F.col("after").alias("other_after"))
    same = (F.col("before") == F.col("other_before")) & (F.col("after") == F.col("other_after"))
    found = chunk.join(gram, "key").where((F.col("word") != F.col("other")) & same & (F.levenshtein("open", "other_open", 1) == 1))
    turned = found.where("extra = 1").select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.select("word", "n", "other", "other_n").unionByName(turned)


def near_words(words: DataFrame, scratch: Scratch, dense: int = DENSE) -> DataFrame:
    """Every ordered pair of distinct words (word, n) one edit apart, once: word, n, other, other_n.

    A key with more than ``dense`` pairs of a chunk and a gram, or of which more than ``WINDOW`` letters are open, is not
    joined: what is not yet known to be whole is cut in halves again, one of which the edit leaves whole, and the words
    join by the longer text. So pairs stay near the number of rows however many words share a chunk, very long words are
    compared in linear time, and none is lost: this ends where a single letter is left.
    """
    rows, found = scratch.written(_chunks_and_grams(words), "chunks"), []
    while True:
        seen = Observation()
        sizes = rows.where("part.high - part.low > 1").groupBy("key").agg(F.count_if("gram").alias("g"), F.count_if(~F.col("gram")).alias("c"), F.max(F.col("part.high") - F.col("part.low")).alias("open"), (F.min(F.xxhash64("word")) != F.max(F.xxhash64("word"))).alias("several"))
        hot = scratch.written(sizes.where(F.col("several") & (F.col("g") * F.col("c") > F.when(F.col("open") > WINDOW, 0).otherwise(dense))).select("key").observe(seen, F.count(F.lit(1)).alias("n")), "dense")
        if not seen.get["n"]:
            found.append(_pairs(rows))
            break
        found.append(_pairs(rows.join(hot, "key", "left_anti")))
        finer = rows.join(hot, "key", "left_semi").select("word", "n", "gram", F.explode(_halves(F.col("part.low"), F.col("part.high"), F.col("part.extra"))).alias("part"))
        rows = scratch.written(_keyed(finer), "chunks")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def variant_groups(words: DataFrame, ratio: int = RATIO, dense: int = DENSE) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n), one row for each.

    Near words differ by one inserted, deleted or replaced code point; ``n_near`` counts them (0 if none). A word's form
    is its near word of largest n (ties: first by code points) if that is at least ``ratio`` times its own, else null.
    The root is the last form that forms lead to, or the word itself. Null words are left out; of a word that is given
    twice the counts are added. Without words the result is empty.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = near_words(words, scratch, dense).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    leads = -F.col("best.n") >= ratio * F.col("n")
    spelled = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.n")).alias("form_n"))
    spelled = scratch.written(spelled, "forms")
    roots = spelled.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are followed; n grows by the ratio with each step
        seen, further = Observation(), roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(further, "root", "left").observe(seen, F.count("next").alias("n"))
        roots = scratch.written(step.select("word", F.coalesce("next", "root").alias("root")), "roots")
        if not seen.get["n"]:
            break
    out = written(spelled.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.clear()
    return out
