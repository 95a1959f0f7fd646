"""Near-duplicate documents by b-bit MinHash.

Each document's set is its distinct five-word shingles. 128 minima give 32 band keys of four minima each; of
every minimum only two low bits stay, packed in four 64-bit numbers. Documents with one band key are candidates;
bit counts of the exclusive or give the share of equal minima, corrected for the one in four that agree by
chance; candidates whose estimate is under 0.53 (4.7 standard deviations from 0.75, one such pair in a million) go. The others are
confirmed on their full sets.

Chances: a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.

Pairs are never expanded within a group. Documents with equal sets are one class first. Then each class is compared
with the smallest one in each of its buckets, and components are found. What is left are buckets in which several
components meet. There, by the packed bits, only classes stay that may be alike to one of another component; these
get their full sets and are confirmed inside the join, which lets only links between components through, each
once. Links within a component would change nothing.

A key with more than ``COMPARED`` rows, such as that of pages made from one template, is not compared pair by pair.
Its classes get their full sets, and all classes of such keys are compared by their rarest shingles, which is exact:
two sets linked share one among the rarest seventh (and one more) of the smaller and the rarest quarter (and one more) of the larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import connected_components
from dossier.llm.shared import Scratch, Words, mix64, pieces, removed, small_batches, windows_hash

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
SIGNATURE = ("s0", "s1", "s2", "s3")
#: The map of a set's shingles that other sets of large keys have too: 1024 places, 64 in each of these numbers.
PLACES = tuple(f"m{k}" for k in range(16))
#: Minima that may differ at most: an estimate of 0.53 (1 - 45 / 128 = 0.25 + 0.75 * 0.53), 4.7 standard deviations below 0.75.
MOST_DIFFERENT = 45
#: Bytes of texts that one numpy pass handles: its arrays take some 25 times that.
TEXTS_AT_ONCE = 1 << 20
#: Bits of the map that tells which texts are looked at again: 8 MB.
MAP_BITS = 26
#: Rows of a key, where components meet, that are compared pair by pair at most; classes of larger keys meet by their rarest shingles.
COMPARED = 512

_LONG = pa.int64()


def _families(seed: int = 20_011) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), draw.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles (A-Z lower-cased)."""
    w = Words(texts, lower=True)
    words = w.hashes()
    shingles = windows_hash(words, size)
    for k, n in enumerate(w.count):
        at = w.first[k]
        if n >= size:
            yield np.unique(shingles[at : at + n - size + 1])
        elif n:
            yield mix64(windows_hash(words[at : at + n], int(n)) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (np.multiply.outer(x[at : at + 512], a) + b).min(axis=0), out=low)
    return low


def _packed(minima: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, 32 of them in each of four 64-bit numbers."""
    bits = (minima & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(minima), 4, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key + m[:, :, r])
    return key


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    return int(mix64(values).sum(dtype=np.uint64).astype(np.int64)), int(mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def signatures(rows: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, uid, n_shingles, set fingerprint (fp0, fp1), packed signature (s0 to s3), band keys (none for an empty set) of rows (doc_id, uid, text)."""
    rows = rows.select("doc_id", "uid", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _families()
        for piece in pieces(batches, "text", TEXTS_AT_ONCE):
            counts, prints, low = [], [], []
            for values in shingle_sets(piece.column("text"), size):
                counts.append(len(values))
                prints.append(_fingerprint(values))
                low.append(_minima(values, a, b))
            low = np.array(low)
            counts, prints, packed = np.array(counts), np.array(prints, dtype=np.int64), _packed(low).view(np.int64)
            keys = _band_keys(low)[counts > 0].view(np.int64).ravel()
            ends = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys, type=_LONG))
            columns = [piece.column("doc_id"), piece.column("uid"), pa.array(counts, type=_LONG), *(pa.array(prints[:, i], type=_LONG) for i in (0, 1)), *(pa.array(packed[:, i].copy(), type=_LONG) for i in range(4)), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "n_shingles", "fp0", "fp1", *SIGNATURE, "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, uid long, n_shingles long, fp0 long, fp1 long, s0 long, s1 long, s2 long, s3 long, bands array<long>")


def full_sets(rows: DataFrame, nodes: DataFrame, size: int = 5) -> DataFrame:
    """node, full set (64-bit hashes) and band keys of the rows (uid, text) whose uid is a ``node``, and of some others.

    Texts are not shuffled: rows are told apart in place by a bit map of hashed numbers, of a fixed size
    (``MAP_BITS``). Others that share a bit pass too, and find no partner where sets are joined by node. The more
    nodes there are, the more pass.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MAP_BITS).alias("at")
    words = nodes.select(place("node")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    rows = rows.select("uid", place("uid"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _families()
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for piece in pieces([batch], "text", TEXTS_AT_ONCE):
                sets = list(shingle_sets(piece.column("text"), size))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), type=_LONG))
                keys = _band_keys(np.array([_minima(s, a, b) for s in sets])).view(np.int64).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys, type=_LONG))
                yield pa.RecordBatch.from_arrays([piece.column("uid"), values, bands], names=["node", "shingles", "bands"])

    return rows.mapInArrow(run, "node long, shingles array<long>, bands array<long>")


def _may_be_alike(x: str, y: str) -> F.Column:
    """The sizes allow the similarity, and so does the estimate from the packed bits."""
    pairs = F.lit(0x5555555555555555)
    different = F.lit(0)
    for s in SIGNATURE:
        xor = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        different = different + F.bit_count(xor.bitwiseOR(F.shiftrightunsigned(xor, 1)).bitwiseAND(pairs))
    m, n = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (4 * F.least(m, n) >= 3 * F.greatest(m, n)) & (different <= MOST_DIFFERENT)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= 75 * union."""
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    return x.where(_alike(F.col("of_a"), F.col("of_b"))).select("a", "b")


def _alike(a: F.Column, b: F.Column) -> F.Column:
    """100 * intersection >= 75 * union, with the intersection named once so that it is computed once."""
    return 7 * F.size(F.array_intersect(a, b)) >= 3 * (F.size(a) + F.size(b))


def _by_rarest(nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of roots by which all components meet that linked classes (node, root, n_shingles, packed bits) connect.

    If x is no larger than y and they are linked, they share 6/7 of x and 3/4 of y at least. So of x's shingles in any
    order common to all sets one of the first n // 7 + 1 is among the first n // 4 + 1 of y's. The rarest come first;
    what only one set has comes before all and meets nothing, so that only its number is needed.

    Each class is first compared with one class at each of its rarest shingles, that with the fewest shingles of its own,
    and components are joined. Then classes of different components are compared, if they can share enough (``_can_share``).
    """
    own = scratch.written(nodes.join(sets.select("node", "shingles"), "node").select("node", F.explode("shingles").alias("shingle")), "shingles")
    shared = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    bit, place = F.expr("shiftleft(1L, cast(shingle & 63 AS int))"), F.shiftrightunsigned("shingle", 60)
    places = [F.bit_or(F.when(place == k, bit).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(PLACES)]
    ranked = own.join(shared, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("shared"), *places)
    ranked = nodes.join(ranked, "node").withColumn("before", F.col("n_shingles") - F.size("shared"))
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.expr("n_shingles div 4 + 1 - before")).cast("int"))
    rare = ranked.select(*nodes.columns, *PLACES, "before", F.posexplode(first).alias("at", "shingle"))
    rare = scratch.written(rare.select(*nodes.columns, *PLACES, "before", F.col("shingle.shingle").alias("shingle"), (F.col("before") + F.col("at")).alias("spot")), "rarest")

    root_of = nodes.select("node", "root")
    heads = rare.groupBy("shingle").agg(F.min(F.struct("before", "node", "root", "n_shingles", *SIGNATURE, *PLACES)).alias("head")).select("shingle", "head.*")
    stars = rare.alias("x").join(heads.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & _may_be_alike("x", "y") & _can_share("x", "y"))
    stars = scratch.written(stars.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), "pairs")
    some = scratch.written(_roots(_confirmed(stars, sets), root_of), "edges")
    joined = connected_components(some).select(F.col("node").alias("root"), F.col("root").alias("higher"))
    rare = rare.join(joined, "root", "left").withColumn("root", F.coalesce("higher", "root"))

    # Whatever two sets share comes no earlier than the first shingle that they share, so that tells how much it is at most.
    ordered = F.struct("x.n_shingles", "x.node") < F.struct("y.n_shingles", "y.node")
    left = F.least(F.col("x.n_shingles") - F.col("x.spot"), F.col("y.n_shingles") - F.col("y.spot"))
    meets = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & ordered & _enough(left, "x", "y") & _may_be_alike("x", "y") & _can_share("x", "y")
    pairs = rare.where("spot <= n_shingles div 7").alias("x").join(rare.alias("y"), meets)
    pairs = scratch.written(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    return some.union(_roots(_confirmed(pairs, sets), root_of))


def _enough(shared: F.Column, x: str, y: str) -> F.Column:
    """So many shared shingles make a link: 100 * intersection >= 75 * union."""
    return 7 * shared >= 3 * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles"))


def _can_share(x: str, y: str) -> F.Column:
    """Two sets can share enough for a link. Exact: a shingle that no other set has is not shared, and one whose place the other set's map leaves empty is not."""

    def at_most(p: str, q: str) -> F.Column:
        alone = F.col(f"{p}.before")
        for c in PLACES:
            alone = alone + F.bit_count(F.col(f"{p}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{q}.{c}"))))
        return F.col(f"{p}.n_shingles") - alone

    return _enough(F.least(at_most(x, y), at_most(y, x)), x, y)


def _roots(links: DataFrame, root_of: DataFrame) -> DataFrame:
    """The links of nodes as links of their roots."""
    for c in ("a", "b"):
        links = links.join(root_of.withColumnRenamed("node", c).withColumnRenamed("root", f"{c}_root"), c)
    return links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, row_col: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    A document with fewer than ``size`` words has its whole sequence as its one shingle; a null or wordless
    text has none, is linked with nothing and is kept. ``component_id`` is the smallest doc_id that the document
    reaches by links, its own included; rows with one doc_id are compared as documents of their own. A row with
    a null id is kept only if no row with an id is in its component (component_id is null then). An empty table
    gives an empty result; other columns are ignored.

    With ``row_col``, long numbers that differ from row to row, it comes along and ``kept`` is decided by row: of
    each component exactly one row is kept, that of the smallest doc_id (null ids last) and then number, and so is
    every row without a shingle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    brief, kept = Scratch(spark), Scratch(spark)  # what is deleted at the end, and what the result reads
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row_col).alias("uid") if row_col else F.monotonically_increasing_id().alias("uid"))
    source = source if row_col else brief.written(source, "rows")  # numbered once, so that the number stays
    marks = kept.written(signatures(source, size), "signatures")
    firsts = [F.first(c).alias(c) for c in (*SIGNATURE, "bands")]
    classes = marks.where(F.col("n_shingles") > 0).groupBy("fp0", "fp1", "n_shingles").agg(F.min("uid").alias("node"), F.min("doc_id").alias("rep"), F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid")).alias("best"), *firsts)
    classes = kept.written(classes, "classes")
    narrow = classes.select("node", "n_shingles", *SIGNATURE)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Full sets of classes, each from the text of the row that gave the class its number."""
        return brief.written(full_sets(source, nodes, size), "sets")

    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where(F.col("head") < F.col("last"))
    rows = brief.written(rows.join(heads.select("key", "head"), "key"), "buckets")  # only what shares a key
    stars = rows.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(narrow.alias("x"), F.col("a") == F.col("x.node")).join(narrow.alias("y"), F.col("b") == F.col("y.node"))
    stars = brief.written(stars.where(_may_be_alike("x", "y")).select("a", "b"), "candidates")
    sets, once_only = sets_of(stars.select(F.explode(F.array("a", "b")).alias("node"))), brief.paths.pop()
    roots = connected_components(_confirmed(stars, sets))
    removed(spark, once_only)

    # Buckets in which components meet. Rows that the packed bits compare with a row of another component stay,
    # get their full sets, and are confirmed where they meet: what leaves the join are links only, each once.
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(narrow, "node")
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "node").alias("head_root"), F.count(F.lit(1)).alias("many")).where("low < high")
    rows = brief.written(rows.join(mixed.select("key", "head_root", "many"), "key"), "mixed")
    large = rows.where(F.col("many") > COMPARED).select("node", "root", "n_shingles", *SIGNATURE).distinct()
    rows = rows.where(F.col("many") <= COMPARED)
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _may_be_alike("x", "y")
    some = brief.written(rows.alias("x").join(rows.alias("y"), meets, "left_semi"), "candidates")
    hot = not large.isEmpty()
    large = brief.written(large, "large") if hot else large
    sets = sets_of(some.select("node").union(large.select("node")) if hot else some.select("node"))
    full = brief.written(some.join(sets, "node"), "candidates")
    x, y = full.where("root != head_root").alias("x"), full.where("node != head").alias("y")
    once = (F.col("x.node") < F.col("y.node")) | (F.col("y.root") == F.col("y.head_root"))
    equal = F.zip_with(F.slice("x.bands", 1, F.col("x.band")), F.slice("y.bands", 1, F.col("x.band")), lambda p, q: p == q)
    again = x.join(y, meets & once & ~F.exists(equal, lambda e: e) & _alike(F.col("x.shingles"), F.col("y.shingles")))
    edges = again.select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    higher = connected_components(edges.union(_by_rarest(large, sets, brief)) if hot else edges)
    brief.clear()

    joined = classes.select("fp0", "fp1", "node", "rep", "best").join(roots, "node", "left").withColumn("low", F.coalesce("root", "node")).drop("root")
    joined = joined.join(higher.select(F.col("node").alias("low"), "root"), "low", "left").withColumn("root", F.coalesce("root", "low"))
    lowest = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("best")["uid"].alias("keeper"))
    named = joined.join(lowest, "root").select("fp0", "fp1", "component_id", "keeper")
    full = marks.select("doc_id", "uid", "n_shingles", "fp0", "fp1").where("n_shingles > 0").join(named, ["fp0", "fp1"])
    if row_col:
        some = full.select("doc_id", F.col("uid").alias(row_col), "n_shingles", "component_id", (F.col("uid") == F.col("keeper")).alias("kept"))
        return some.union(marks.where("n_shingles = 0").select("doc_id", "uid", "n_shingles", "doc_id", F.lit(True)))
    out = full.select("doc_id", "n_shingles", "component_id").union(marks.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
