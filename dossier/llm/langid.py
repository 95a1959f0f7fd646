"""Language of documents: script ranges, then Viterbi over per-word scores with a switching penalty.

A naive Bayes model over byte n-grams of words gives each word a score in each language. The script of a word's
letters, by ranges of code points, narrows its languages to those that were learned with that script. Viterbi then
labels every word: a change of language costs a fixed penalty, so that short foreign words do not break a span, and
long ones do. How sure a label is comes from the margin: what its words score in it above the next best language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import PIECE_BYTES, Words, pieces

ORDERS = (2, 3, 4)
BUCKETS = 1 << 18
SWITCH_PENALTY = 12.0
#: Languages at most, more raise an error before anything runs: a model has a megabyte for each. Up to ``DENSE``, tasks
#: count in an array of all buckets and languages.
MOST_LANGUAGES, DENSE = 1000, 32
#: Words whose n-grams are in memory at a time.
WORDS_A_TIME = 1 << 16
SPANS = "array<struct<start: int, end: int, lang: string>>"

# First and last code points of the letters of each script, as Unicode's blocks have them.
SCRIPT_RANGES = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xB5, 0xB5), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6), ("latin", 0xF8, 0x2AF), ("mark", 0x300, 0x36F),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F), ("hebrew", 0x591, 0x5FF), ("arabic", 0x610, 0x6FF), ("syriac", 0x700, 0x74F), ("arabic", 0x750, 0x77F), ("thaana", 0x780, 0x7BF),
    ("nko", 0x7C0, 0x7FF), ("arabic", 0x8A0, 0x8FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1820, 0x18AF), ("georgian", 0x1C90, 0x1CBF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("latin", 0x2C60, 0x2C7F), ("kana", 0x3041, 0x30FF), ("bopomofo", 0x3105, 0x312F), ("hangul", 0x3131, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("latin", 0xA722, 0xA7FF), ("hangul", 0xA960, 0xA97F), ("hangul", 0xAC00, 0xD7FF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFC), ("latin", 0xFF21, 0xFF3A),
    ("latin", 0xFF41, 0xFF5A), ("kana", 0xFF66, 0xFF9F), ("hangul", 0xFFA0, 0xFFDC), ("han", 0x20000, 0x3FFFF),
)
#: Scripts by number; letters of no range above are of the last one. Marks belong to the script of their word.
SCRIPT_NAMES = (*dict.fromkeys(name for name, _, _ in SCRIPT_RANGES if name != "mark"), "other")
SCRIPTS = len(SCRIPT_NAMES)
_FIRST = np.array([a for _, a, _ in SCRIPT_RANGES], dtype=np.int64)
_LAST = np.array([z for _, _, z in SCRIPT_RANGES], dtype=np.int64)
_NUMBER = np.array([-1 if name == "mark" else SCRIPT_NAMES.index(name) for name, _, _ in SCRIPT_RANGES], dtype=np.int8)
#: Code points above ASCII that are no letters though they are in no range: signs, punctuation, symbols, private ones, emoji.
_NO_LETTER = ((0x80, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2B0, 0x2FF), (0x1680, 0x1680), (0x2000, 0x2BFF), (0x2E00, 0x303F), (0x3200, 0x33FF), (0x4DC0, 0x4DFF), (0xD800, 0xF8FF), (0xFE00, 0xFE4F), (0xFF00, 0xFF20), (0xFFF0, 0xFFFF), (0x1F000, 0x1FAFF), (0xE0000, 0x10FFFF))
_ASCII = np.full(128, -1, dtype=np.int8)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = 0


def scripts_of(code: np.ndarray) -> np.ndarray:
    """The script number of each code point, -1 for those that are no letters."""
    at = np.searchsorted(_FIRST, code, side="right") - 1
    inside = (at >= 0) & (code <= _LAST[np.maximum(at, 0)])
    out = np.where(inside, _NUMBER[np.maximum(at, 0)], np.int8(SCRIPTS - 1))
    for a, z in _NO_LETTER:
        out[~inside & (code >= a) & (code <= z)] = -1
    out[(code < 0x80) & ~inside] = -1
    return out


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """At the first byte of each character of a UTF-8 text its script number; -1 at other bytes and where it is no letter."""
    out = np.full(len(data), -1, dtype=np.int8)
    plain = data < 0x80
    out[plain] = _ASCII[data[plain]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & (0x3F >> size)
        for k in range(1, 4):
            more = np.flatnonzero(size >= k)
            code[more] = code[more] << 6 | (data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F)
        kinds, back = np.unique(code, return_inverse=True)
        out[lead] = scripts_of(kinds)[back]
    return out


def grams(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every byte n-gram within a word, its bounds included, and the word it is in; ``WORDS_A_TIME`` words at a time."""
    for low in range(0, len(w.start), WORDS_A_TIME):
        begin, end = w.start[low : low + WORDS_A_TIME], w.end[low : low + WORDS_A_TIME]
        data, begin, end = w.data[begin[0] : end[-1]], begin - begin[0], end - begin[0]
        size = end - begin + 2  # a bound on each side
        first = np.concatenate([[0], np.cumsum(size)])
        padded = np.full(first[-1], 0x20, dtype=np.uint8)
        word = np.repeat(np.arange(len(begin), dtype=np.int32), size)
        inner = np.ones(first[-1], dtype=bool)
        inner[first[:-1]] = inner[first[1:] - 1] = False
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[begin] += 1
        inside[end] -= 1
        padded[inner] = data[np.cumsum(inside, dtype=np.int8)[:-1] > 0]
        for order in ORDERS:
            m = len(padded) - order + 1
            if m <= 0:
                continue
            h = np.full(m, order, dtype=np.uint32)
            for j in range(order):
                h = h * np.uint32(0x01000193) + padded[j : j + m]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            own = word[:m] == word[order - 1 :]
            yield (h >> np.uint32(14))[own], word[:m][own] + np.int64(low)


def word_scripts(w: Words) -> np.ndarray:
    """Of each word the script of its letters (the largest number, if there are several: any other before Latin); -1 without letters."""
    return np.maximum.reduceat(byte_scripts(w.data), w.start) if len(w.start) else np.empty(0, np.int8)


def train(docs: DataFrame, max_rows: int = 20_000, seed: int = 11) -> dict:
    """A model from (text, lang): fit on at most about ``max_rows`` rows, chosen by a hash of the text.

    Counts are summed in the tasks and then over tasks by bucket; what comes to the driver is a table of
    ``BUCKETS`` times the number of languages at most. Null texts and null languages are no part of it. More than
    ``MOST_LANGUAGES`` languages raise a ValueError.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    by_lang = known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, total = [r["lang"] for r in by_lang], sum(r["count"] for r in by_lang)
    if not langs:
        return {"langs": []}
    share = min(1.0, max_rows / total)
    sample = known.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1))
    size, number = len(langs), {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scripts = np.zeros(BUCKETS * size if size <= DENSE else 0, dtype=np.int64), np.zeros(SCRIPTS * size, dtype=np.int64)
        for piece in pieces(batches, "text"):
            w = Words(piece.column("text"), lower=True)
            label = np.array([number[x] for x in piece.column("lang").to_pylist()], dtype=np.int64)
            of_word = np.repeat(label, w.count)
            for key, owner in grams(w):
                at, n = np.unique(key.astype(np.int64) * size + of_word[owner], return_counts=True)
                if size <= DENSE:
                    sums[at] += n
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["at", "n"])
            script = word_scripts(w)
            scripts += np.bincount(script[script >= 0].astype(np.int64) * size + of_word[script >= 0], minlength=len(scripts))
        for x, start in ((sums, 0), (scripts, BUCKETS * size)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(at + start, pa.int32()), pa.array(x[at])], names=["at", "n"])

    found = sample.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    by = np.argsort(at)
    at, n = at[by], n[by]
    grams_end = int(np.searchsorted(at, BUCKETS * size))
    whole = np.bincount(at[:grams_end] % size, weights=n[:grams_end], minlength=size) + 0.5 * BUCKETS
    weights = np.empty((BUCKETS, size), dtype=np.float32)
    for low in range(0, BUCKETS, 4096):
        a, z = np.searchsorted(at, [low * size, (low + 4096) * size])
        gram = np.bincount(at[a:z] - low * size, weights=n[a:z], minlength=4096 * size).reshape(-1, size)
        logs = np.log((gram + 0.5) / whole)
        # What no language has says nothing (else it would speak for that with the fewest n-grams).
        weights[low : low + 4096] = np.where(gram.any(axis=1, keepdims=True), logs - logs.mean(axis=1, keepdims=True), 0)
    script = np.bincount(at[grams_end:] - BUCKETS * size, weights=n[grams_end:], minlength=SCRIPTS * size).reshape(-1, size)
    seen = script / np.maximum(script.sum(axis=0), 1) > 0.001
    learned = seen.copy()
    seen[~seen.any(axis=1)] = True  # a script of no language narrows nothing
    prior = np.array([r["count"] for r in by_lang]) / total
    return {"langs": langs, "weights": weights, "scripts": seen, "learned": learned, "prior": np.log(prior).astype(np.float32)}


def word_scores(w: Words, model: dict, script: np.ndarray) -> np.ndarray:
    """Score of every word in every language (0 for words without letters)."""
    size = len(model["langs"])
    out = np.zeros((len(w.start), size), dtype=np.float32)
    for key, owner in grams(w):
        low, n = int(owner[0]) if len(owner) else 0, int(owner[-1] - owner[0]) + 1 if len(owner) else 0
        for k in range(size if n else 0):
            out[low : low + n, k] += np.bincount(owner - low, weights=model["weights"][:, k][key], minlength=n)
    out[script < 0] = 0
    out[(script >= 0)[:, None] & ~model["scripts"][np.maximum(script, 0)]] -= 30
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word of every text, all texts of a batch step by step together."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    live = order[count[order] > 0]
    n, size = len(scores), scores.shape[1]
    came = np.zeros((n, size), dtype=np.int16)
    label = np.zeros(n, dtype=np.int16)
    if not len(live):
        return label
    at, longest = first[live], count[live]
    best = scores[at] + prior
    active = len(live)
    stay = np.arange(size, dtype=np.int16)
    for t in range(1, int(longest[0])):
        active = int(np.searchsorted(-longest, -t, "left"))
        now = best[:active]
        top = now.argmax(axis=1)
        jump = now[np.arange(active), top][:, None] - penalty
        changed = jump > now
        i = at[:active] + t
        came[i] = np.where(changed, top[:, None].astype(np.int16), stay)
        best[:active] = np.where(changed, jump, now) + scores[i]
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(int(longest[0]) - 1, -1, -1):
        active = int(np.searchsorted(-longest, -t, "left"))
        i = at[:active] + t
        label[i] = state[:active]
        state[:active] = came[i, state[:active]]
    return label


def sureness(scores: np.ndarray, script: np.ndarray, doc: np.ndarray, top: np.ndarray, docs: int) -> np.ndarray:
    """1 - exp(-margin) of each text's language; 1 if only one was learned, 0 for a text without words with letters."""
    size = scores.shape[1]
    words = np.bincount(doc[script >= 0], minlength=docs)
    if size == 1:
        return (words > 0).astype(float)
    total = np.stack([np.bincount(doc, weights=scores[:, k], minlength=docs) for k in range(size)], axis=1).astype(float)
    own = total[np.arange(docs), top].copy()
    total[np.arange(docs), top] = -np.inf
    return 1 - np.exp(-np.maximum(own - total.max(axis=1), 0) / np.maximum(words, 1))


def identify_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, carry: bool = False) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, ``share`` and ``spans`` (start, end, lang) in code points.

    ``lang_pred`` is the language of most letters and ``share`` its share of them. ``score`` is the share times
    the letters' share in scripts that it was learned in, times 1 - exp(-margin): the margin is by how much all words of the text score better in it than in the next best
    language, for each word with letters. So a text that no learned language fits has a low score, though it gets
    the nearest one. Both are from 0 to 1. A text that is null or has no letter, or a model without languages,
    gives ``und``, zeros and no spans. Rows are handled one by one and whole, whatever their ids; other
    columns are ignored; an empty table gives an empty result. With ``carry`` all columns of a row come along, as
    the struct ``row`` in place of doc_id.
    """
    text, first = F.col(text_col), "row" if carry else "doc_id"
    rows = docs.select((F.struct(*docs.columns) if carry else F.col(id_col)).alias(first), text.cast("binary").alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model["langs"]
        # Words have a score in each language, so the more languages, the fewer words at a time.
        for piece in pieces(batches, "text", PIECE_BYTES * DENSE // max(DENSE, len(langs))):
            docs, letters = piece.num_rows, piece.column("letters").to_numpy(zero_copy_only=False)
            if not langs:
                names, share, score, spans = ["und"] * docs, np.zeros(docs), np.zeros(docs), [[]] * docs
            else:
                w = Words(piece.column("text"), lower=True)
                script = word_scripts(w)
                scores = word_scores(w, model, script)
                label = viterbi(scores, w.first, model["prior"], penalty).astype(np.int64)
                doc = w.doc()
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                begin, end = chars[w.start] - chars[w.offsets[doc]], chars[w.end] - chars[w.offsets[doc]]
                weight = np.where(script >= 0, end - begin, 0)
                sums = np.bincount(doc * len(langs) + label, weights=weight, minlength=docs * len(langs)).reshape(docs, -1)
                top = np.where(sums.any(axis=1), sums.argmax(axis=1), int(model["prior"].argmax()))
                share = np.where(letters, np.where(sums.any(axis=1), sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1), 0.0), 0.0)
                fits = np.bincount(doc, weights=weight * model["learned"][script, top[doc]], minlength=docs) / np.maximum(sums.sum(axis=1), 1)
                score = share * fits * sureness(scores, script, doc, top, docs)
                names = [langs[k] if ok else "und" for k, ok in zip(top, letters, strict=True)]
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])) if len(doc) else np.empty(0, int)
                last = np.append(cut[1:], len(doc)) - 1 if len(doc) else cut
                spans = [[] for _ in range(docs)]
                for c, e in zip(cut, last, strict=True):
                    if letters[doc[c]]:
                        spans[doc[c]].append({"start": int(begin[c]), "end": int(end[e]), "lang": langs[label[c]]})
            yield pa.RecordBatch.from_arrays([piece.column(first), pa.array(names), pa.array(score, type=pa.float64()), pa.array(share, type=pa.float64()), pa.array(spans, type=kind)], names=[first, "lang_pred", "score", "share", "spans"])

    return rows.mapInArrow(run, f"{first} {rows.schema[first].dataType.simpleString()}, lang_pred string, score double, share double, spans {SPANS}")


def remainder(id_col: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo ``of`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))
