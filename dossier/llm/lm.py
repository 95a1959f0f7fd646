"""Language model scoring with an Elias-Fano n-gram trie of three levels.

Training takes two passes over the texts. The first counts words: words are dealt to shards by hash, and each shard
becomes a file of its sorted word hashes (Elias-Fano) with exact counts. A word's number is its place in all
shards. The second pass counts trigrams of word numbers (behind a text's end stands one more mark, so that these
hold all bigrams too). Trigrams are dealt by the shard of the first word and a hash of the first two, so that the
trie below a very common word is spread over many files. In a file:

* roots: the first words (Elias-Fano), and a pointer from each to its first successor;
* pairs: the second words, the probability code of each after its first word, and a pointer to the first successor;
* triples: the third words and their codes; for each pair also the mass left for the shorter context.

Pointers are monotone and Elias-Fano coded. A successor is stored as its number in just enough bits and is searched
only in the range that its context's pointers give. Probabilities are discounted and have 8-bit codes, what is
left of a context has 16 bits. All n-grams are kept; only a caller's ``min_count`` over 1 prunes those seen less
often, and their mass goes to the shorter context. Probability: p_n = code(successor) + left(context) * p_(n-1),
down to the smoothed p_1.

Files are memory-mapped where they lie in the shared folder, each when it is first asked for, and at most
``OPEN_FILES`` at a time in a task. Where the folder is not mounted they are read through Arrow's file systems.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.eliasfano import EliasFano, encode, pack, unpack
from dossier.llm.shared import Words, mix64, pieces, shared_path

_U = np.uint64
CODE_STEPS = 24  # codes for each power of ten
DISCOUNT = 0.75
END = _U(0x5EED0F7E47E4D0E1)
#: Bytes of text for a shard of trigrams and of words, shards of words at most, and tokens that a task gathers before it packs them.
SHARD_BYTES, WORD_SHARD_BYTES, WORD_SHARDS, GATHER = 16 << 20, 64 << 20, 4096, 1_000_000
#: Files that a task keeps mapped at a time.
OPEN_FILES = 1024


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and its end, and how many each text has."""
    w = Words(texts, lower=True)
    out = np.full(len(w.start) + len(w.count), END, dtype=_U)
    last = np.cumsum(w.count + 1) - 1
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = w.hashes()
    return out, w.count + 1


def places(count: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and for each element the number of its value."""
    by = np.argsort(x)
    s = x[by]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    back = np.empty(len(x), dtype=np.int64)
    back[by] = np.cumsum(new) - 1
    return s[new], back


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of key columns (the first is the main one) in order, and the sums of their counts."""
    by = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, counts = [k[by] for k in keys], counts[by]
    if not len(counts):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[first] for k in keys], np.add.reduceat(counts, first)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs and the elements in it."""
    if not len(shard):
        return
    by = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1]]))
    for a, z in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        yield int(shard[by[a]]), by[a:z]


def _thin(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs (a first byte tells)."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes) -> np.ndarray:
    width, raw = data[0], np.frombuffer(data, dtype=np.uint8, offset=1)
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").ravel()


def _gaps(keys: np.ndarray) -> bytes:
    return _thin(np.diff(keys, prepend=_U(0)))


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data), dtype=_U)


def _rows(columns: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if isinstance(c, int) else pa.binary() for c in columns[0]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), kinds, strict=True)], names=names)


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that names the arrays, then each at a multiple of 64 bytes. Written aside, then renamed."""
    import os
    import uuid

    from pyarrow import fs

    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [str(x.dtype), len(x), at]
        at += -(-x.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    aside = f"{where}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(line)
        for x in arrays.values():
            out.write(x.tobytes())
            out.write(b"\0" * (-x.nbytes % 64))
    if store.get_file_info(where).type == fs.FileType.File:  # of an attempt before; not every store replaces on a move
        store.delete_file(where)
    store.move(aside, where)


def _read(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, memory-mapped if it can be; None if there is no such file."""
    place = urlparse(path)
    try:
        if place.scheme in ("", "file"):
            data = np.memmap(place.path, dtype=np.uint8, mode="r")
        else:
            from pyarrow import fs

            store, where = fs.FileSystem.from_uri(path)
            with store.open_input_file(where) as f:
                data = np.frombuffer(f.read(), dtype=np.uint8)
    except FileNotFoundError:
        return None
    stop = 64
    while data[stop - 1] != 10:
        stop += 64
    head = json.loads(data[:stop].tobytes())
    return {name: data[stop + at : stop + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head.items()}


def _sequence(prefix: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in encode(values).items()}


def _opened(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k: arrays[f"{prefix}.{k}"] for k in ("low", "high", "zeros", "shape")})


def _codes(share: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(-np.log10(share) * CODE_STEPS), 255).astype(np.uint8)


def _shares(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-codes.astype(float) / CODE_STEPS)


def _left(taken: np.ndarray) -> np.ndarray:
    """What shares that sum to ``taken`` leave of a context, in 16 bits."""
    return np.maximum(np.floor((1 - taken) * 65535), 1).astype(np.uint16)


def _shard_of(pair: np.ndarray, word_shard: np.ndarray, spread: int) -> np.ndarray:
    return word_shard * spread + (mix64(pair) % _U(spread)).astype(np.int64)


class Trie:
    """The model's files, opened when they are asked for."""

    def __init__(self, model: dict):
        self.model, self.bases = model, np.array(model["bases"], dtype=np.int64)
        self.open: OrderedDict[str, dict | None] = OrderedDict()

    def file(self, name: str) -> dict | None:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        arrays = _read(f"{self.model['path']}/{name}")
        if arrays:
            coded = {k.rpartition(".")[0] for k in arrays if k.endswith(".shape")}
            arrays = {k: v for k, v in arrays.items() if "." not in k} | {k: _opened(arrays, k) for k in coded}
        self.open[name] = arrays
        if len(self.open) > OPEN_FILES:
            self.open.popitem(last=False)
        return arrays

    def words(self, token: np.ndarray, left: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1: unknown), exact count, and what a context of this one word leaves, of each token."""
        keys, back = distinct(token)
        number, counts, rest = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64), np.ones(len(keys))
        for s, at in by_shard((keys % _U(len(self.bases))).astype(np.int64)):
            if (x := self.file(f"words-{s}")) is None:
                continue
            found = x["word"].find(keys[at])
            at, found = at[found >= 0], found[found >= 0]
            number[at], counts[at] = self.bases[s] + found, x["counts"][found]
            if left and (y := self.file(f"left-{s}")) is not None:
                rest[at] = y["left"][found] / 65535.0
        return number[back], counts[back], rest[back]

    def split(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place in it of each word number."""
        shard = np.searchsorted(self.bases, number, side="right") - 1
        return shard, number - self.bases[shard]

    def below(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of the pairs (first, second) and of the triples, and what each pair leaves as a context; numbers of known words."""
        shard, local = self.split(first)
        pair = local.astype(_U) * _U(self.model["types"]) + second.astype(_U)
        two, three, left = np.zeros(len(pair)), np.zeros(len(pair)), np.ones(len(pair))
        for s, at in by_shard(_shard_of(pair, shard, self.model["spread"])):
            if (x := self.file(f"grams-{s}")) is None:
                continue
            keys, back = distinct(pair[at])
            root, word = np.divmod(keys, _U(self.model["types"]))
            new = np.concatenate([[True], root[1:] != root[:-1]])
            index = x["root"].find(root[new])[np.cumsum(new) - 1]
            known = np.flatnonzero(index >= 0)
            node = np.full(len(keys), -1, dtype=np.int64)
            node[known] = _within(x, "second", x["to_pair"].get(index[known]), x["to_pair"].get(index[known] + 1), word[known])
            hit = node >= 0
            share, rest = np.zeros(len(keys)), np.ones(len(keys))
            share[hit], rest[hit] = _shares(x["codes2"][node[hit]]), x["left"][node[hit]] / 65535.0
            two[at], left[at] = share[back], rest[back]
            asked = np.flatnonzero((node[back] >= 0) & (third[at] >= 0))
            parent = node[back[asked]]
            begin, end = (p[np.searchsorted(u, parent)] for u in (np.unique(parent),) for p in (x["to_triple"].get(u), x["to_triple"].get(u + 1)))
            child = _within(x, "third", begin, end, third[at[asked]].astype(_U))
            three[at[asked[child >= 0]]] = _shares(x["codes3"][child[child >= 0]])
        return two, three, left


def _within(x: dict, name: str, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each word in the range of its context, or -1: a binary search in all ranges at a time."""
    a, z = begin.copy(), end.copy()
    width = int(x["width"][0])
    open_ = np.flatnonzero(a < z)
    while len(open_):
        middle = (a[open_] + z[open_]) >> 1
        less = unpack(x[name], width, middle) < word[open_]
        a[open_[less]] = middle[less] + 1
        z[open_[~less]] = middle[~less]
        open_ = open_[a[open_] < z[open_]]
    hit = np.flatnonzero(a < end)
    hit = hit[unpack(x[name], width, a[hit]) == word[hit]]
    out = np.full(len(word), -1, dtype=np.int64)
    out[hit] = a[hit]
    return out


def _word_parts(rows: DataFrame, shards: int) -> DataFrame:
    """shard, gaps of sorted word hashes and counts: a row for each shard and ``GATHER`` tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            (keys,), counts = summed([np.concatenate(gathered)], np.ones(held, dtype=np.int64))
            yield _rows([(s, _gaps(keys[at]), _thin(counts[at])) for s, at in by_shard((keys % _U(shards)).astype(np.int64))], ["shard", "keys", "counts"])

        gathered, held = [], 0
        for piece in pieces(batches, "text"):
            gathered.append(tokens(piece.column("text"))[0])
            held += len(gathered[-1])
            if held >= GATHER:
                yield from flush()
                gathered, held = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "shard long, keys binary, counts binary")


def _gram_parts(rows: DataFrame, model: dict) -> DataFrame:
    """shard, gaps of sorted pairs, children of each, third words and counts: a row for each shard and ``GATHER`` tokens of a task."""
    types, spread = model["types"], model["spread"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, third = (np.concatenate([g[k] for g in gathered]) for k in range(3))
            shard, local = trie.split(first)
            pair = local.astype(_U) * _U(types) + second.astype(_U)
            out = []
            for s, at in by_shard(_shard_of(pair, shard, spread)):
                (p, w), counts = summed([pair[at], third[at].astype(_U)], np.ones(len(at), dtype=np.int64))
                new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                out.append((s, _gaps(p[new]), _thin(np.diff(np.append(new, len(p)))), _thin(w), _thin(counts)))
            if out:
                yield _rows(out, ["shard", "pairs", "children", "third", "counts"])

        gathered, held = [], 0
        for piece in pieces(batches, "text"):
            token, count = tokens(piece.column("text"))
            number, _, _ = trie.words(token, left=False)
            after = np.append(number[2:], [types, types])
            ends = np.cumsum(count) - 2  # the last pair of a text has no third word but the mark behind all numbers
            after[ends[count > 1]] = types
            at = np.flatnonzero(places(count) < np.repeat(count, count) - 1)
            at = at[(number[at] >= 0) & (number[at + 1] >= 0) & (after[at] >= 0)]
            gathered.append((number[at], number[at + 1], after[at]))
            held += len(at)
            if held >= GATHER:
                yield from flush()
                gathered, held = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "shard long, pairs binary, children binary, third binary, counts binary")


def train(docs: DataFrame, text_col: str = "text", min_count: int = 1, path: str | None = None) -> dict:
    """Builds the trie of all texts (null: empty) below ``path`` in the shared folder; returns what scoring needs.

    What comes to the driver is one small row for each shard of words, ``WORD_SHARDS`` at most; the model itself
    stays in the files. Shards of trigrams grow in number with the bytes of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = min(WORD_SHARDS, max(4, -(-size // WORD_SHARD_BYTES)))
    spread = max(1, -(-size // (SHARD_BYTES * shards)))
    path = path or shared_path(spark, "trie")

    def build_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([f(x.as_py()) for x in table.column(c)]) for c, f in (("keys", _from_gaps), ("counts", _wide)))
        (keys,), counts = summed([keys], counts.astype(np.int64))
        _write(f"{path}/words-{key[0].as_py()}", {**_sequence("word", keys), "counts": counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else _U)})
        return pa.table({"shard": pa.array([key[0].as_py()]), "types": pa.array([len(keys)]), "tokens": pa.array([int(counts.sum())])})

    parts = {p["shard"]: p for p in _word_parts(rows, shards).groupBy("shard").applyInArrow(build_words, "shard long, types long, tokens long").collect()}
    types = [parts[s]["types"] if s in parts else 0 for s in range(shards)]
    model = {"path": path, "bases": [sum(types[:s]) for s in range(shards)], "types": sum(types), "spread": spread, "tokens": sum(p["tokens"] for p in parts.values())}

    def build_grams(key: tuple, table: pa.Table) -> pa.Table:
        shard, mark = key[0].as_py(), _U(model["types"])
        pair = np.concatenate([np.repeat(_from_gaps(p.as_py()), _wide(n.as_py()).astype(np.int64)) for p, n in zip(table.column("pairs"), table.column("children"), strict=True)])
        third, counts = (np.concatenate([_wide(x.as_py()) for x in table.column(c)]) for c in ("third", "counts"))
        (pair, third), counts = summed([pair, third], counts.astype(np.int64))
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        of_pair, pairs = np.add.reduceat(counts, start), pair[start]
        number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pair))))
        # Triples: the children of each pair that is kept, without the mark behind a text's end.
        kept = np.flatnonzero(of_pair >= min_count)
        place = np.full(len(start), -1, dtype=np.int64)
        place[kept] = np.arange(len(kept))
        real = np.flatnonzero((counts >= min_count) & (third != mark))
        codes3 = _codes((counts[real] - DISCOUNT) / of_pair[number[real]])
        parent = place[number[real]]
        left = _left(np.bincount(parent, weights=_shares(codes3), minlength=len(kept)))
        # Pairs: the share of each after its first word, whose exact count is in the file of its shard.
        root, second = np.divmod(pairs[kept], mark)
        word_counts = Trie(model).file(f"words-{shard // spread}")["counts"].astype(np.int64)
        codes2 = _codes((of_pair[kept] - DISCOUNT) / word_counts[root.astype(np.int64)])
        firsts, begin = np.unique(root, return_index=True)
        width = int(mark).bit_length()
        arrays = {
            **_sequence("root", firsts), **_sequence("to_pair", np.append(begin, len(kept)).astype(_U)), "second": pack(second, width), "codes2": codes2,
            **_sequence("to_triple", np.searchsorted(parent, np.arange(len(kept) + 1)).astype(_U)), "third": pack(third[real], width), "codes3": codes3,
            "left": left, "width": np.array([width]),
        }
        _write(f"{path}/grams-{shard}", arrays)
        taken = np.add.reduceat(_shares(codes2), begin) if len(begin) else np.empty(0)
        return pa.table({"shard": pa.array([shard // spread]), "words": pa.array([_gaps(firsts)], pa.binary()), "taken": pa.array([taken.tobytes()], pa.binary())})

    def build_left(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        taken = np.zeros(types[shard])
        for words, some in zip(table.column("words"), table.column("taken"), strict=True):
            taken[_from_gaps(words.as_py()).astype(np.int64)] += np.frombuffer(some.as_py())
        left = np.where(taken > 0, _left(np.minimum(taken, 1)), 65535).astype(np.uint16)
        _write(f"{path}/left-{shard}", {"left": left})
        return pa.table({"shard": pa.array([shard])})

    if model["tokens"]:
        grams = _gram_parts(rows, model).groupBy("shard").applyInArrow(build_grams, "shard long, words binary, taken binary")
        grams.groupBy("shard").applyInArrow(build_left, "shard long").agg(F.count("*")).collect()
    return model


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, base_score (unigrams), score (the model), log10.

    A null text is empty and has its end as its one token. Rows are scored one by one and whole, whatever their
    ids; other columns are ignored; an empty table gives an empty result. A model of no text gives each token
    probability 1.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        whole = model["tokens"] + 0.5 * (model["types"] + 1)
        for piece in pieces(batches, "text"):
            token, count = tokens(piece.column("text"))
            place, doc = places(count), np.repeat(np.arange(len(count)), count)
            number, seen, rest = trie.words(token)
            base = (seen + 0.5) / whole
            p = base.copy()
            two = np.flatnonzero(place >= 1)
            p[two] = rest[two - 1] * p[two]  # and the share of the pair, below
            first, second = number[two - 1], number[two]
            known = np.flatnonzero((first >= 0) & (second >= 0))
            # A pair is asked for once, as the last two words of a bigram; its triple is the one that it begins.
            begin = two[known] - 1
            third = np.full(len(begin), -1, dtype=np.int64)
            more = np.flatnonzero((begin + 2 < len(token)) & (place[np.minimum(begin + 2, len(token) - 1)] >= 2))
            third[more] = number[begin[more] + 2]
            share2, share3, left = trie.below(first[known], second[known], third)
            p[two[known]] += share2
            last = begin[more] + 2
            p[last] = share3[more] + left[more] * p[last]
            total = lambda x: pa.array(np.bincount(doc, weights=x, minlength=len(count)), pa.float64())  # noqa: B023, E731
            n_known = pa.array(np.bincount(doc[seen > 0], minlength=len(count)), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(count, pa.int64()), n_known, total(np.log10(base)), total(np.log10(p))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
