"""Exact top-k search by inner product with cover trees over the data and over the queries, pruned in pairs of nodes.

All rows, queries among them, are dealt to the cells of a net of centres and packed into blocks, each with a cover tree
of its own below the cell. Groups of queries form a tree too. A pair of a query node and a data node is left out if no
pair of their vectors can reach the worst k-th score of that group: with centres a, b and covering radii r, s no inner
product exceeds a.b + r|b| + s|a| + rs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.shared import Scratch, written

#: Rows of a block (as dealt by hash), points that a tree splits no further, and children of a node.
BLOCK, LEAF, FANOUT = 2048, 64, 16
#: Rows of which the net's centres are taken, and most centres.
SAMPLE, CELLS = 8192, 1024
#: Numbers in query vectors, twice those that one pass over the blocks searches for on average.
PASS_NUMBERS = 1 << 22
#: Blocks that the first round of a pass looks at, to learn k-th scores, and how many times more each next round does.
FIRST, GROWTH = 64, 32
NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """A cover tree over the rows of ``x``, reordered so that each node is the rows ``start:end``; ``order`` has their old places."""

    x: np.ndarray
    order: np.ndarray
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    norm: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)


def cover_tree(x: np.ndarray) -> Tree:
    """The tree: the children of a node are centred on a net of its points, farthest first, and cover half its radius.

    Points that no more than ``FANOUT`` such centres cover are a child of their own, with the node's centre. Where
    that would be most of them, as in data without clusters, the node stays whole.
    """
    x = np.asarray(x, dtype=np.float64)
    order, tree = np.arange(len(x)), Tree(x, np.arange(len(x)))
    todo = [(0, len(x), x[np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))], -1)]
    while todo:
        start, end, centre, parent = todo.pop()
        of = x[order[start:end]]
        near = np.sqrt(((of - centre) ** 2).sum(axis=1))
        radius, node = float(near.max()), len(tree.start)
        for name, value in (("start", start), ("end", end), ("centre", centre), ("radius", radius * (1 + 1e-9)), ("norm", float(np.linalg.norm(centre))), ("children", [])):
            getattr(tree, name).append(value)
        if parent >= 0:
            tree.children[parent].append(node)
        if end - start <= LEAF or radius == 0:
            continue
        centres, owner = [centre], np.zeros(end - start, dtype=np.int64)
        while near.max() > radius / 2 and len(centres) < FANOUT:
            centres.append(of[near.argmax()])
            far = np.sqrt(((of - centres[-1]) ** 2).sum(axis=1))
            owner[far < near] = len(centres) - 1
            near = np.minimum(near, far)
        owner[near > radius / 2] = len(centres)
        sizes = np.bincount(owner, minlength=len(centres) + 1)
        if sizes[-1] > (end - start) / 2:
            continue
        order[start:end] = order[start:end][np.argsort(owner, kind="stable")]
        ends = start + np.cumsum(sizes)
        todo += [(int(e - n), int(e), c, node) for e, n, c in zip(ends, sizes, [*centres, centre], strict=True) if n]
    tree.x, tree.order = x[order], order
    return tree


class Best:
    """The best ``k`` candidates of each query of a tree so far: score, id and row, best first; ``worst`` is the score to reach."""

    def __init__(self, tree: Tree, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        self.tree, self.k = tree, k
        self.ids, self.rows, self.worst = ids[tree.order], rows[tree.order], floor[tree.order].copy()
        n = len(self.ids)
        self.score, self.found_id, self.found_row = np.full((n, k), NONE), np.full((n, k), NONE), np.full((n, k), NONE)
        self.most = float(np.sqrt((tree.x**2).sum(axis=1)).max())

    def search(self, data: Tree, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes in a block: node pairs from the most promising on; a pair that cannot reach its group's worst k-th score ends."""
        q, most = self.tree, float(np.sqrt((data.x**2).sum(axis=1)).max())
        exact = self.most * most
        if exact >= 2**62:
            raise OverflowError("inner products need more than 63 bits")
        whole = exact < 2**52  # products of doubles are exact then; else whole numbers are multiplied
        xd = data.x if whole else data.x.astype(np.int64)
        ids, rows = ids[data.order], rows[data.order]

        def bound(a: int, b: int) -> float:
            centres = float(q.centre[a] @ data.centre[b])
            return centres + abs(centres) * 1e-9 + q.radius[a] * data.norm[b] + data.radius[b] * q.norm[a] + q.radius[a] * data.radius[b] + 1.0

        todo = [(bound(0, 0), 0, 0)]
        while todo:
            reach, a, b = todo.pop()
            if reach < self.worst[q.start[a] : q.end[a]].min():
                continue
            split_a = q.children[a] and (not data.children[b] or q.radius[a] >= data.radius[b])
            if split_a:
                todo += sorted((bound(c, b), c, b) for c in q.children[a])
            elif data.children[b]:
                todo += sorted((bound(a, c), a, c) for c in data.children[b])
            else:
                for at in range(q.start[a], q.end[a], 512):
                    to = min(q.end[a], at + 512)
                    xq = q.x[at:to] if whole else q.x[at:to].astype(np.int64)
                    for on in range(data.start[b], data.end[b], 4096):
                        off = min(data.end[b], on + 4096)
                        self._take(at, xq @ xd[on:off].T, ids[on:off], rows[on:off])

    def _take(self, at: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merges the scores of the queries from ``at`` on: those at least their worst, without a query's own row."""
        k, n = self.k, len(scores)
        floor = self.worst[at : at + n]
        if scores.shape[1] > 4 * k:  # only a score among the k + 1 greatest of these (one may be the query's own) can count
            floor = np.maximum(floor, np.partition(scores, -k - 1, axis=1)[:, -k - 1].astype(np.int64))
        i, j = np.nonzero(scores >= floor[:, None])
        other = rows[j] != self.rows[at + i]
        i, j = i[other], j[other]
        if not len(i):
            return
        hit = np.unique(i)
        old = np.repeat(hit, k), self.score[at + hit].ravel(), self.found_id[at + hit].ravel(), self.found_row[at + hit].ravel()
        new = i, scores[i, j].astype(np.int64), ids[j], rows[j]
        who, score, found, row = (np.concatenate(x) for x in zip(old, new, strict=True))
        there = row != NONE
        who, score, found, row = who[there], score[there], found[there], row[there]
        by = np.lexsort((row, found, -score, who))
        who, score, found, row = who[by], score[by], found[by], row[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < k
        who, place = at + who[kept], place[kept]
        self.score[who, place], self.found_id[who, place], self.found_row[who, place] = score[kept], found[kept], row[kept]
        full = at + hit
        self.worst[full] = np.maximum(self.worst[full], self.score[full, k - 1])

    def table(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.found_row != NONE)
        columns = (self.rows[at], self.ids[at], self.found_row[at, place], self.found_id[at, place], self.score[at, place])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "row", "id", "score"])


#: Null ids are last among ties.
LAST = np.iinfo(np.int64).max
FOUND = "query_row long, query_id long, row long, id long, score long"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.int64).reshape(len(column), width)


def _centres(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By dimension the centres of the cells: a net, farthest first, of at most ``SAMPLE`` rows chosen by hash, one for a block."""
    share = max(1, -(-count // SAMPLE))
    picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("x").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r.x), []).append(r.x)
    out = {}
    for width, vectors in by.items():
        x = np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
        found = [x[0]]
        near = ((x - x[0]) ** 2).sum(axis=1)
        while len(found) < min(CELLS, -(-count // BLOCK)) and near.max() > 0:
            found.append(x[near.argmax()])
            near = np.minimum(near, ((x - found[-1]) ** 2).sum(axis=1))
        out[width] = np.array(found)
    return out


def _celled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their width and the cell whose centre is nearest (0 if no centre has their width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            cell = np.zeros(len(width), dtype=np.int32)
            for w in np.unique(width):
                if w in centres:
                    at, c = np.flatnonzero(width == w), centres[w]
                    x = _matrix(batch.column("x").take(pa.array(at)), w).astype(np.float64)
                    for k in range(0, len(at), 1024):
                        cell[at[k : k + 1024]] = ((c**2).sum(axis=1) - 2 * (x[k : k + 1024] @ c.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    rows = rows.withColumn("width", F.size("x"))
    return rows.mapInArrow(run, "row long, id long, query boolean, x array<long>, width int, cell int")


def _packed(celled: DataFrame, k: int) -> DataFrame:
    """A row for each block: its cell and width, ids, rows and vectors as bytes, and of its queries the k-th score inside the block.

    A cell of many rows is many blocks; a row's block is drawn by its number.
    """
    sizes = celled.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = celled.join(sizes, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        width, n = group.column("width")[0].as_py(), group.num_rows
        x = _matrix(group.column("x"), width)
        ids, rows = group.column("id").to_numpy(), group.column("row").to_numpy()
        asks = np.flatnonzero(group.column("query").to_numpy(zero_copy_only=False).astype(bool))
        low = np.zeros(0, dtype=np.int64)
        if len(asks):
            best = Best(cover_tree(x[asks]), ids[asks], rows[asks], np.full(len(asks), NONE), k)
            best.search(cover_tree(x), ids, rows)
            low = np.empty(len(asks), dtype=np.int64)
            low[best.tree.order] = best.worst
        small = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or np.abs(x).max(initial=0) <= np.iinfo(t).max)
        packs = {"ids": ids, "rows": rows, "x": x.astype(small), "query_ids": ids[asks], "query_rows": rows[asks], "query_x": x[asks].astype(small), "low": low}
        one = {"n": [n], "asks": [len(asks)], "kind": [np.dtype(small).str]} | {c: [v.tobytes()] for c, v in packs.items()}
        one |= {c: [group.column(c)[0].as_py()] for c in ("width", "cell", "block")}
        return pa.table(one).select(names).cast(schema)

    kinds = {"width": "int", "cell": "int", "block": "int", "n": "int", "asks": "int", "kind": "string", **dict.fromkeys(("ids", "rows", "x", "query_ids", "query_rows", "query_x", "low"), "binary")}
    names, of = list(kinds), {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, of[t]) for c, t in kinds.items()])
    packed = dealt.select("width", "cell", "block", "row", "id", "query", "x").groupBy("width", "cell", "block").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return packed.withColumn("draw", F.pmod(F.xxhash64("width", "cell", "block"), F.lit(1 << 30)))


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids and rows of a block, or of its queries."""
    ids, rows = (np.frombuffer(row[prefix + c], dtype=np.int64) for c in ("ids", "rows"))
    return np.frombuffer(row[prefix + "x"], dtype=row["kind"]).reshape(len(ids), row["width"]), ids, rows


Asked = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _asked(blocks: list[dict]) -> Asked:
    """By width the queries of these blocks: vectors, ids, rows, and the scores that their k-th at least has."""
    by: dict[int, list] = {}
    for b in blocks:
        x, ids, rows = _unpacked(b, "query_")
        by.setdefault(b["width"], []).append((x.astype(np.int64), ids, rows, np.frombuffer(b["low"], dtype=np.int64)))
    return {w: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for w, parts in by.items()}


def _search(spark: SparkSession, blocks: DataFrame, asked: Asked, k: int) -> DataFrame:
    """What each task finds in its blocks for the queries (a broadcast of the vectors of one pass and their tree)."""
    shared = spark.sparkContext.broadcast({w: (cover_tree(x), ids, rows, low) for w, (x, ids, rows, low) in asked.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = batch.slice(k_, 1).to_pylist()[0]
                if row["width"] not in shared.value:
                    continue
                if row["width"] not in best:
                    tree, ids, rows, low = shared.value[row["width"]]
                    best[row["width"]] = Best(tree, ids, rows, low, k)
                x, ids, rows = _unpacked(row)
                best[row["width"]].search(cover_tree(x), ids, rows)
        yield from (b.table() for b in best.values())

    return blocks.select("width", "kind", "ids", "rows", "x").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query row, with their rank."""
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "x", first: int = FIRST, pass_numbers: int = PASS_NUMBERS) -> DataFrame:
    """For each row that is a ``query`` the ``k`` other rows of greatest inner product (all, if fewer): query_id, rank, id and score.

    Vectors are arrays of whole numbers; scores are exact (``OverflowError`` beyond 62 bits). Ties go to the smaller id
    (null ids last); a query's own row is none of its candidates, but rows of the same id are. Null arrays and those with
    a null take no part, and vectors meet only those of their own size. Without rows or queries the result is empty.

    Every row is indexed; only the net's centres come from a sample. Blocks' queries are dealt
    to passes by hash, half of ``pass_numbers`` numbers to each on average; a pass broadcasts them and reads all blocks, in rounds of more and more of them: after each, the k-th scores are
    the next one's bar, so that a query gets some hundred rows of all tasks however many there are. A lost executor
    costs its tasks, as blocks and results are written to the shared folder.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kept = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(vector_col).cast("array<long>").alias("x"))
    kept = kept.where("x IS NOT NULL AND NOT exists(x, c -> c IS NULL)").withColumn("row", F.monotonically_increasing_id()).select("row", "id", "query", "x")
    kept = scratch.written(kept, "vectors")
    count, asking, numbers = kept.agg(F.count("*"), F.count_if("query"), F.coalesce(F.sum(F.when(F.col("query"), F.size("x") + 1)), F.lit(0))).first()
    parts, root = [], None
    if asking:
        celled = scratch.written(_celled(kept, _centres(kept, count)), "cells")
        blocks = scratch.written(_packed(celled, k), "blocks")
        total = blocks.count()
        passes = -(-2 * numbers // pass_numbers)
        for p in range(passes):
            mine = blocks.where((F.col("asks") > 0) & (F.pmod(F.xxhash64("cell", "block"), F.lit(passes)) == p))
            mine = [r.asDict() for r in mine.select("width", "kind", "query_ids", "query_rows", "query_x", "low").collect()]
            if not mine:
                continue
            asked, upto, found = _asked(mine), 0, []
            share = min(1.0, first / total)
            while upto < 1 << 30:
                to = 1 << 30 if share >= 1 else int(share * (1 << 30))
                seen = _search(spark, blocks.where((F.col("draw") >= upto) & (F.col("draw") < to)), asked, k)
                for old in found:
                    seen = seen.unionByName(old)
                best = scratch.written(_first(seen, k).select("query_row", "query_id", "row", "id", "score"), "found")
                found, upto, share = [best], to, share * GROWTH
                if upto < 1 << 30:
                    bars = {r.query_row: r.low for r in best.groupBy("query_row").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
                    asked = {w: (x, ids, rs, np.maximum(low, [bars.get(int(r), NONE) for r in rs])) for w, (x, ids, rs, low) in asked.items()}
            parts += found
    out = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        out = out.unionByName(part)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = _first(out, k).select(known("query_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), known("id").alias(id_col), "score")
    out = written(out, "neighbours")
    scratch.clear()
    return out
