"""Benchmark decontamination by latent semantic retrieval.

Texts are lower-cased and split at white space and punctuation. Words are hashed to ``FEATURES`` features; their document frequencies are counted over all documents. The
benchmark's passages, as TF-IDF rows, are factored by a randomised SVD whose passes over the rows are Spark jobs.
Every window of every document is folded in the same space, and windows whose cosine to a passage reaches a low
threshold are candidates. A candidate is confirmed by the longest common subsequence with the passage, and for a
paraphrase also by the passage's answer (its last sentence). Words that were exchanged are no part of a subsequence:
a window near the passage in the latent space is a paraphrase with fewer words in order, endings aside.

A passage that the space cannot hold is looked up by its rarest words instead. These are passages of which a copy of
three quarters, amid words as rare as any, would stay below the threshold: short ones, which a window dilutes, and
those of which the space keeps little.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import Words, hash_ranges, pieces

FEATURES = 1 << 18
#: Windows of a document: two blocks, moving by one.
BLOCK = 32
#: Latent dimensions at most, extra ones while factoring, and power rounds.
RANK, EXTRA, ROUNDS = 160, 16, 2
#: Benchmark passages that one pass over the documents compares (about 100 MB in a task), and cosines computed at a time.
PASSAGES_A_PASS, COSINES = 1 << 16, 1 << 20
#: Bytes of texts that are searched at a time.
SEARCHED_BYTES = 1 << 20
MIN_COSINE = 0.2
#: Features of many documents are left out of a window's coordinates as long as no passage has more than this share
#: of its squared norm in them; a cosine changes by no more than that.
COMMON_SHARE = 0.05
#: Share of a passage's words in order that is a copy; that is a paraphrase, if the answer is there too.
COPY, PARAPHRASE, ANSWER = 0.75, 0.55, 0.8
#: Latent cosine from which this share of the stems in order is a paraphrase, if the answer is there; bytes of a stem.
MEANT, EXCHANGED, STEM = 0.25, 0.45, 5
SHORT = 8
#: Rare words found in texts, each times the passages that have it, that are compared at a time.
HITS_A_TIME = 1 << 20


#: Bytes between words here: white space, controls and ASCII punctuation. Texts are lower-cased by Spark.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that have each feature, over the whole table, and documents. Tasks sum in an array of ``FEATURES``."""
    rows = docs.select(F.lower(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(FEATURES, dtype=np.int64), 0
        for piece in pieces(batches, "text"):
            w = Words(piece.column("text"), apart=_APART)
            own = w.doc() * FEATURES + _features(w.hashes())
            own.sort()
            sums += np.bincount(own[np.flatnonzero(np.diff(own, prepend=-1))] % FEATURES, minlength=FEATURES)
            n += piece.num_rows
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], n))], names=["feature", "n"])

    table = rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, found = table["feature"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(FEATURES, dtype=np.int64)
    df[feature[feature >= 0]] = found[feature >= 0]
    return df, int(found[feature < 0].sum())


class Rows:
    """TF-IDF rows of texts with norm one, in flat arrays."""

    def __init__(self, texts: pa.Array, idf: np.ndarray):
        w = Words(texts, apart=_APART)
        key, count = np.unique(w.doc() * FEATURES + _features(w.hashes()), return_counts=True)
        self.row, self.feature, self.n = key // FEATURES, key % FEATURES, len(w.count)
        value = count * idf[self.feature]
        norm = np.sqrt(np.bincount(self.row, weights=value**2, minlength=self.n))
        self.value = value / np.maximum(norm[self.row], 1e-12)

    def times(self, dense: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, dense.shape[1]))
        np.add.at(out, self.row, self.value[:, None] * dense[place[self.feature]])
        return out


def factor(bench: DataFrame, idf: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features of the benchmark and their latent coordinates (orthonormal columns), by a randomised SVD.

    Each round multiplies the rows with a basis and their transpose with that, in tasks; the partial sums of a
    block of features meet in one task. The driver holds the basis: features of the benchmark (``FEATURES`` at
    most) times ``RANK + EXTRA``.
    """
    idf_shared = bench.sparkSession.sparkContext.broadcast(idf)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, dtype=bool)
        for piece in pieces(batches, "text"):
            seen[Rows(piece.column("text"), idf_shared.value).feature] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["feature"])

    used = np.sort(bench.mapInArrow(present, "feature long").distinct().toArrow()["feature"].to_numpy())
    place = np.full(FEATURES, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    width = min(RANK + EXTRA, len(used))
    if not width:
        return used, np.zeros((0, 0), np.float32)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(used), width)))[0]

    def multiplied(basis: np.ndarray) -> np.ndarray:
        shared = bench.sparkSession.sparkContext.broadcast((place, basis.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, basis = shared.value
            total = np.zeros(basis.shape)
            for piece in pieces(batches, "text"):
                a = Rows(piece.column("text"), idf_shared.value)
                np.add.at(total, place[a.feature], a.value[:, None] * a.times(basis, place)[a.row])
            for at in range(0, len(total), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + 4096].tobytes()], pa.binary())], names=["at", "sums"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
            return pa.table({"at": pa.array([key[0].as_py()]), "sums": pa.array([total.tobytes()], pa.binary())})

        blocks = bench.mapInArrow(run, "at long, sums binary").groupBy("at").applyInArrow(add, "at long, sums binary").collect()
        shared.destroy()
        return np.concatenate([np.frombuffer(b["sums"]).reshape(-1, basis.shape[1]) for b in sorted(blocks, key=lambda b: b["at"])])

    for _ in range(ROUNDS):
        basis = np.linalg.qr(multiplied(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ multiplied(basis))
    idf_shared.destroy()
    keep = np.flatnonzero(values > values.max() * 1e-9)[::-1][:RANK]
    return used, (basis @ turn[:, keep]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of it in the bits of one number."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := where.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Passage:
    """A benchmark passage: hashes of its words, of its stems, and where its answer begins, the last sentence (or its last five words)."""

    __slots__ = ("_counts", "item", "last", "stems", "words")

    def __init__(self, item, words: np.ndarray, stems: np.ndarray, last: int):
        self.item, self.words, self.stems, self._counts = item, words, stems, None
        self.last = last if 0 < last <= len(words) - 3 else max(0, len(words) - 5)

    def counts(self) -> Counter:
        """Its words in order of their first places, with their numbers; kept for passages that are ever compared."""
        if self._counts is None:
            self._counts = Counter(self.words.tolist())
        return self._counts


def passages_of(block: list[tuple]) -> list[Passage]:
    """The passages that have words, of (item, text) pairs."""
    w = Words(pa.array([text.encode() for _, text in block], pa.large_binary()), apart=_APART)
    hashes, stems, out = hash_ranges(w.data, w.start, w.end), stems_of(w), []
    stop = np.isin(w.data[np.minimum(w.end, len(w.data) - 1)], np.frombuffer(b".!?", dtype=np.uint8)) if len(w.data) else np.empty(0, bool)
    for k, (item, _) in enumerate(block):
        a, z = int(w.first[k]), int(w.first[k + 1])
        if z > a:
            stops = np.flatnonzero(stop[a : z - 1])
            out.append(Passage(item, hashes[a:z], stems[a:z], int(stops[-1]) + 1 if len(stops) else 0))
    return out


def stems_of(w: Words) -> np.ndarray:
    """A hash of the first ``STEM`` bytes of each word: words that differ in their endings only are one."""
    return hash_ranges(w.data, w.start, np.minimum(w.end, w.start + STEM))


def confirm_meant(passage: Passage, stems: list[int]) -> tuple[int, str] | None:
    """The common subsequence of stems and ``paraphrase``, or None, for a window that is near the passage in the latent space."""
    n, own, there = len(passage.stems), passage.stems.tolist(), set(stems)
    if n < SHORT or sum(x in there for x in own) < EXCHANGED * n:
        return None
    common = common_subsequence(own, stems)
    answer = own[passage.last :]
    if common >= EXCHANGED * n and common_subsequence(answer, stems) >= ANSWER * len(answer):
        return common, "paraphrase"
    return None


def confirm(passage: Passage, words: list[int]) -> tuple[int, str] | None:
    """The common subsequence and ``copy`` or ``paraphrase``, or None. Passages under eight words must stand there word for word."""
    n, there = len(passage.words), set(words)
    if sum(c for x, c in passage.counts().items() if x in there) < PARAPHRASE * n:
        return None  # no common subsequence is longer
    own = passage.words.tolist()
    if n < SHORT:
        here = any(words[k : k + n] == own for k in range(len(words) - n + 1))
        return (n, "copy") if here else None
    common = common_subsequence(own, words)
    if common >= COPY * n:
        return common, "copy"
    answer = own[passage.last :]
    if common >= PARAPHRASE * n and common_subsequence(answer, words) >= ANSWER * len(answer):
        return common, "paraphrase"
    return None


class Anchors:
    """The rarest words of each passage that the space cannot hold, enough of them that a text without ``need`` of these cannot be confirmed.

    A confirmed text has at least the share ``PARAPHRASE`` of a passage's words, so ``spare`` words may be missing;
    of a passage under ``SHORT`` words none may.
    Of the rarest words, ``spare`` and a fifth of the passage more, it has all but ``spare``. Nothing is lost by
    leaving the others out.
    """

    def __init__(self, known: list[Passage], held: np.ndarray, idf: np.ndarray):
        posts: list[tuple[int, int, int]] = []
        need, size = np.zeros(len(known), dtype=np.int64), np.array([len(p.words) for p in known], dtype=np.int64)
        for k in np.flatnonzero(~held).tolist():
            p = known[k]
            n, taken = len(p.words), 0
            spare = n - math.ceil(PARAPHRASE * n - 1e-9) if n >= SHORT else 0
            words, first, count = np.unique(p.words, return_index=True, return_counts=True)
            for i in np.lexsort((first, -idf[_features(words)])).tolist():
                if taken >= spare + max(2, n // 5):
                    break
                posts.append((int(words[i]), k, int(count[i])))
                taken += int(count[i])
            need[k] = taken - spare
        posts.sort()
        word = np.array([x[0] for x in posts], dtype=np.uint64)
        self.words, first = np.unique(word, return_index=True)
        self.first = np.append(first, len(posts))
        self.owner, self.weight = (np.array([x[i] for x in posts], dtype=np.int64) for i in (1, 2))
        self.has = np.zeros(FEATURES, dtype=bool)
        self.has[_features(self.words)] = True
        self.need, self.before = need, np.maximum(16, size // 2)
        self.stretch, self.step = size + self.before, np.maximum(8, size // 4)

    def candidates(self, w: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, begin, end) of the stretches of words that may hold the passage."""
        at = np.flatnonzero(self.has[_features(hashes)])
        if not len(at):
            return
        word = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        same = self.words[word] == hashes[at]
        at, word = at[same], word[same]
        fan, doc = self.first[word + 1] - self.first[word], np.searchsorted(w.first, at, "right") - 1
        ends = np.cumsum(fan)
        gap = int(self.stretch.max()) + 1
        wide = len(hashes) + gap * (len(w.count) + 1)
        begin = 0
        while begin < len(at):
            done = int(ends[begin - 1]) if begin else 0
            end = int(np.searchsorted(ends, done + HITS_A_TIME, "right"))
            if end < len(at):  # whole texts only
                whole = int(np.searchsorted(doc, doc[end]))
                end = whole if whole > begin else int(np.searchsorted(doc, doc[end], "right"))
            some = fan[begin:end]
            hit = np.repeat(np.arange(begin, end), some)
            post = self.first[word[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(some) - some, some)
            begin = end
            key = self.owner[post] * wide + at[hit] + doc[hit] * gap
            by = np.argsort(key)
            key, hit, post = key[by], hit[by], post[by]
            owner, sums = self.owner[post], np.concatenate([[0], np.cumsum(self.weight[post])])
            until = np.searchsorted(key, key + self.stretch[owner])
            past = -1
            for i in np.flatnonzero(sums[until] - sums[:-1] >= self.need[owner]).tolist():
                if key[i] < past:
                    continue
                d, k, spot = int(doc[hit[i]]), int(owner[i]), int(at[hit[i]])
                past = int(key[i] + self.step[k])
                yield d, k, max(int(w.first[d]), spot - int(self.before[k])), min(int(w.first[d + 1]), spot + int(self.stretch[k] + self.step[k]))


class Retrieval:
    """The fitted space of a benchmark and its passages, in blocks."""

    def __init__(self, docs: DataFrame, text_col: str, bench: DataFrame, item_col: str, bench_text_col: str, min_cosine: float):
        from pyspark.sql.pandas.types import to_arrow_type

        self.spark = docs.sparkSession
        self.item_kind = bench.schema[item_col].dataType
        self.item_type = to_arrow_type(self.item_kind)
        self.passages = bench.select(F.col(item_col).alias("item_id"), F.lower(bench_text_col).alias("text")).where(F.col("text").isNotNull())
        df, n = document_frequencies(docs, text_col)
        self.idf = np.log((1 + n) / (1 + df)) + 0.05
        used, self.coordinates = factor(self.passages.select(F.col("text").cast("binary").alias("text")), self.idf)
        self.place = np.full(FEATURES, -1, dtype=np.int32)
        self.place[used] = np.arange(len(used))
        self.place[self.idf < self.common_below()] = -1
        self.base = self.spark.sparkContext.broadcast((self.place, self.coordinates, self.idf.astype(np.float32), min_cosine))

    def common_below(self) -> float:
        """The greatest of some cuts of the inverse document frequency below which no passage has more than ``COMMON_SHARE``."""
        cuts, idf = np.arange(0, 6, 0.25), self.spark.sparkContext.broadcast(self.idf)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worst = np.zeros(len(cuts))
            for piece in pieces(batches, "text"):
                a = Rows(piece.column("text"), idf.value)
                for k, cut in enumerate(cuts):
                    low = idf.value[a.feature] < cut
                    worst[k] = max(worst[k], np.bincount(a.row[low], weights=a.value[low] ** 2, minlength=1).max())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts))), pa.array(worst)], names=["cut", "share"])

        texts = self.passages.select(F.col("text").cast("binary").alias("text"))
        shares = texts.mapInArrow(run, "cut long, share double").groupBy("cut").agg(F.max("share").alias("share")).collect()
        idf.destroy()
        return max((cuts[r["cut"]] for r in shares if r["share"] <= COMMON_SHARE), default=0.0)

    def blocks(self) -> Iterator:
        """What the tasks of each pass over the documents get, broadcast: ``PASSAGES_A_PASS`` passages at most."""
        block: list = []
        for r in self.passages.orderBy("item_id").toLocalIterator():
            block.append((r["item_id"], r["text"]))
            if len(block) == PASSAGES_A_PASS:
                yield self._shared(block)
                block = []
        if block:
            yield self._shared(block)

    def _shared(self, block: list) -> tuple:
        return self.base, self.spark.sparkContext.broadcast((uuid.uuid4().hex, block))


#: What a worker has made of the last block, for the tasks that follow in it.
_prepared: dict[str, tuple] = {}


def _searched(batches: Iterator[pa.RecordBatch], shared: tuple) -> Iterator[tuple[pa.RecordBatch, list[Passage], list[tuple]]]:
    """Each piece with the passages and the confirmed pairs in it."""
    (place, coordinates, idf, min_cosine), (name, block) = (s.value for s in shared)
    if name not in _prepared:
        known = passages_of(block)
        target, norms = latent(known, place, coordinates, idf)
        _prepared.clear()
        _prepared[name] = (known, target, Anchors(known, held(known, norms, idf, min(min_cosine, MIN_COSINE)), idf)) if known else ([], None, None)
    known, target, rare = _prepared[name]
    for piece in pieces(batches, "text", SEARCHED_BYTES):
        yield piece, known, search(piece.column("text"), known, rare, target, place, coordinates, idf, min_cosine) if known else []


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each pair of a document and a passage in it: doc_id, item_id, common, item_words, cosine, verdict.

    All windows of all documents are compared with all passages; up to ``PASSAGES_A_PASS`` of them take one pass over the documents. Passages
    without words and null texts match nothing. Rows are handled one by one whatever their ids, equal passages
    each match; other columns are ignored; with either table empty the result is empty. A passage longer than a
    window is found by a window's cosine and then confirmed as a whole. Passages that the space cannot hold (``held``) are
    found by their rarest words too; the cosine is then that of the words confirmed. A ``min_cosine`` above ``MIN_COSINE``
    finds less: what the space holds is looked for there alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).cast("binary").alias("text"))
    space = Retrieval(docs, text_col, bench, item_col, bench_text_col, min_cosine)
    item_type = space.item_type
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {space.item_kind.simpleString()}, common long, item_words long, cosine double, verdict string"
    out = docs.sparkSession.createDataFrame([], schema)

    def one_pass(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, known, found in _searched(batches, shared):
                ids = piece.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                columns = [[known[f[1]].item for f in found], [f[2] for f in found], [len(known[f[1]].words) for f in found], [f[3] for f in found], [f[4] for f in found]]
                types = [item_type, pa.int64(), pa.int64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "item_id", "common", "item_words", "cosine", "verdict"])

        return rows.mapInArrow(run, schema)

    for shared in space.blocks():
        out = out.union(one_pass(shared))
    return out


def drop_leaking(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows, with all their columns, that have no passage of the benchmark. One pass over them for each block of passages."""
    space, kept = Retrieval(docs, text_col, bench, item_col, bench_text_col, min_cosine), docs

    def one_pass(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, _, found in _searched(batches, shared):
                clean = np.ones(piece.num_rows, dtype=bool)
                clean[[f[0] for f in found]] = False
                yield pa.RecordBatch.from_arrays([piece.column("row").filter(pa.array(clean))], names=["row"])

        rows = rows.select(F.struct(*rows.columns).alias("row"), F.lower(text_col).cast("binary").alias("text"))
        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")

    for shared in space.blocks():
        kept = one_pass(kept, shared)
    return kept


def latent(known: list[Passage], place: np.ndarray, coordinates: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent coordinates of the passages, of norm one, and the norms that they had."""
    out = np.zeros((len(known), coordinates.shape[1]), dtype=np.float32)
    for k, p in enumerate(known):
        feature = _features(p.words)
        feature = feature[place[feature] >= 0]
        out[k] = (idf[feature, None] * coordinates[place[feature]]).sum(axis=0)
    norms = np.linalg.norm(out, axis=1)
    return out / np.maximum(norms[:, None], 1e-9), norms


def held(known: list[Passage], norms: np.ndarray, idf: np.ndarray, min_cosine: float) -> np.ndarray:
    """Which passages a window shows: the cosine of a copy of ``COPY`` of one, in its best window and amid the rarest of words, is above the threshold.

    A copy of n words may be cut by windows; of n up to 33 one window has all, of up to 64 one has at least 16 + n / 2
    (of more, 48).
    """
    size = np.array([len(p.words) for p in known])
    there = COPY * np.where(size <= BLOCK + 1, 1.0, np.minimum(16 + size / 2, 1.5 * BLOCK) / np.maximum(size, 1))
    mass = np.array([float((idf[_features(p.words)] ** 2).sum()) for p in known])
    others = np.maximum(2 * BLOCK - there * size, 0) * float(idf.max()) ** 2
    return (size >= SHORT) & (there * norms >= min_cosine * np.sqrt(there * mass + others))


def search(texts: pa.Array, known: list[Passage], rare: Anchors, target: np.ndarray, place: np.ndarray, coordinates: np.ndarray, idf: np.ndarray, min_cosine: float) -> list[tuple]:
    """(text, passage, common, cosine, verdict) of confirmed pairs, each with its best window or its best stretch of rare words."""
    w = Words(texts, apart=_APART)
    if not len(w.start):
        return []
    hashes = hash_ranges(w.data, w.start, w.end)
    out, more = by_windows(w, hashes, stems_of(w), known, target, place, coordinates, idf, min_cosine), {}
    for d, k, a, z in rare.candidates(w, hashes):
        if (d, k) in out or more.get((d, k), (0,))[0] == len(known[k].words):
            continue
        if verdict := confirm(known[k], hashes[a:z].tolist()):
            more[d, k] = max(more.get((d, k), (0,)), (verdict[0], _cosine(known[k].counts(), Counter(hashes[a:z].tolist()), idf), verdict[1]))
    return [(d, int(k), common, cosine, verdict) for (d, k), (common, cosine, verdict) in sorted((out | more).items())]


def _cosine(a: Counter, b: Counter, idf: np.ndarray) -> float:
    """Of the TF-IDF rows of two counters of words."""
    weight = {x: float(idf[x >> 46]) ** 2 for x in a.keys() | b.keys()}
    norm = math.sqrt(sum(weight[x] * n * n for x, n in a.items()) * sum(weight[x] * n * n for x, n in b.items()))
    return sum(weight[x] * n * b[x] for x, n in a.items()) / max(norm, 1e-12)


def by_windows(w: Words, hashes: np.ndarray, stems: np.ndarray, known: list[Passage], target: np.ndarray, place: np.ndarray, coordinates: np.ndarray, idf: np.ndarray, min_cosine: float) -> dict[tuple[int, int], tuple]:
    """Common words, cosine and verdict of confirmed pairs (text, passage) by the latent cosine of their windows."""
    feature = _features(hashes)
    doc = w.doc()
    in_doc = np.arange(len(doc)) - w.first[doc]
    begins = np.flatnonzero(in_doc % BLOCK == 0)
    block_doc = doc[begins]
    weight = idf[feature]
    mass = np.add.reduceat(weight**2, begins)
    at = place[feature]
    inside = at >= 0
    own = np.add.reduceat(np.where(inside, weight**2, 0), begins)

    def pair(x: np.ndarray) -> np.ndarray:
        """Sums of each block and the next of the same text."""
        out = x.copy()
        same = np.flatnonzero(block_doc[1:] == block_doc[:-1])
        out[same] += x[same + 1]
        return out

    # The squared cosine is at most the share of the window's mass that lies in benchmark words (all of one sign:
    # a feature that repeats counts more in both, so a factor of two is left).
    likely = np.flatnonzero(2 * pair(own) >= min_cosine**2 * pair(mass))
    if not len(likely):
        return {}
    needed = np.zeros(len(begins) + 1, dtype=bool)
    needed[likely] = needed[likely + 1] = True
    block_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(doc))))
    take = np.flatnonzero(inside & needed[:-1][block_of])
    sums = np.zeros((len(begins), coordinates.shape[1]), dtype=np.float32)
    for cut in range(0, len(take), 1 << 14):
        t = take[cut : cut + (1 << 14)]
        b = block_of[t]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        sums[b[first]] += np.add.reduceat(coordinates[at[t]] * weight[t, None], first, axis=0)
    windows = pair(sums)[likely]
    norm = np.sqrt(pair(mass)[likely])
    out: dict[tuple[int, int], tuple] = {}
    step = max(1, COSINES // len(known))
    for cut in range(0, len(likely), step):
        cosine = windows[cut : cut + step] @ target.T / norm[cut : cut + step, None]
        for i, k in zip(*np.nonzero(cosine >= min_cosine), strict=True):
            b, p = int(likely[cut + i]), known[k]
            d, span = int(block_doc[b]), max(16, len(p.words) // 2)
            a, z = max(int(w.first[d]), int(begins[b]) - span), min(int(w.first[d + 1]), int(begins[b]) + 2 * BLOCK + max(span, len(p.words) - BLOCK))
            verdict = confirm(p, hashes[a:z].tolist())
            if not verdict and cosine[i, k] >= MEANT:
                verdict = confirm_meant(p, stems[a:z].tolist())
            if verdict:
                out[d, k] = max(out.get((d, k), (0,)), (verdict[0], float(cosine[i, k]), verdict[1]))
    return out
