"""Evidence and requirements by cosine of their vectors.

Requirements are packed once into an index of blocks in the shared folder: a row for each block with its unit vectors,
their centre and the radius around it. Queries stay where they are read; each task walks over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dossier.plans.versions import version_as_of
from dossier.sources.tables import scratch_path

#: Requirement vectors of a block, and query rows that a task compares with a block at once.
BLOCK, CHUNK = 4096, 16_384
#: Estimated bytes of requirements that are packed without counting them first: a block for each group.
SMALL_BYTES = 4 << 20
#: Vectors of which the centres of an index are taken, and most centres.
SAMPLE, CELLS = 8192, 1024


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the places of vectors that are whole and no zero vectors, and a matrix of these with norm one."""
    column = column.combine_chunks()
    sizes, found = pc.fill_null(pc.list_value_length(column), 0).to_numpy(), {}
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.linalg.norm(x, axis=1)
        whole = np.isfinite(norm) & (norm > 0)
        found[int(d)] = (at[whole], x[whole] / norm[whole, None])
    return found


@dataclass
class VectorIndex:
    """Blocks of requirement vectors below ``root``: columns g, ids, d, vectors, centre and radius, a row for each block."""

    root: str
    id_kind: object
    grouped: bool

    def blocks(self, groups: pa.Array, columns: list[str]) -> Iterator[dict]:
        """The blocks of these groups, always in the same order; few are in memory at a time."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        table = ds.dataset(base, filesystem=store, format="parquet")
        for batch in table.to_batches(columns=columns, filter=pc.field("g").isin(groups), batch_size=4, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i] for c in columns}


def build_index(requirements: DataFrame, within: str | None = None, block: int = BLOCK, root: str | None = None) -> VectorIndex:
    """Packs requirements (requirement_id, v and the column ``within``) into blocks of about ``block`` vectors of one group and dimension.

    A group of more vectors is cut along cells around centres, so that the vectors of a block are alike and its bound is
    tight; a cell of more is cut by hash. The centres are a net of at most ``SAMPLE`` vectors chosen by hash; every vector is
    indexed. Null and zero vectors and null ids are in no block.
    """
    spark, root, id_kind = requirements.sparkSession, root or scratch_path(requirements.sparkSession), requirements.schema["requirement_id"].dataType
    group = F.col(within) if within else F.lit(0)
    held = requirements.where("v IS NOT NULL AND requirement_id IS NOT NULL").select(group.alias("g"), F.col("requirement_id").alias("id"), "v", F.size("v").alias("d")).where("g IS NOT NULL")
    most, total = 0, 0
    if block < BLOCK or int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        most, total = held.groupBy("g", "d").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if most > block:
        centres = _centres(held, total, -(-most // block))
        celled = _in_cells(held, centres)
        sizes = celled.groupBy("g", "d", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        held = celled.join(sizes, ["g", "d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    else:
        held = held.withColumns({"cell": F.lit(0), "part": F.lit(0)})
    g_type, id_type = to_arrow_type(held.schema["g"].dataType), to_arrow_type(id_kind)
    schema = pa.schema([("g", g_type), ("d", pa.int32()), ("ids", pa.list_(id_type)), ("vectors", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        units = _units(rows.column("v"))
        if not units or not len(next(iter(units.values()))[0]):
            return schema.empty_table()
        ((d, (at, x)),) = units.items()
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        ids = rows.column("id").combine_chunks().take(pa.array(at))
        return pa.table([[rows.column("g")[0].as_py()], [d], [ids.to_pylist()], [x.tobytes()], [centre.tobytes()], [radius]], schema=schema)

    kinds = f"g {held.schema['g'].dataType.simpleString()}, d int, ids array<{id_kind.simpleString()}>, vectors binary, centre binary, radius double"
    held.select("g", "d", "cell", "part", "id", "v").groupBy("g", "d", "cell", "part").applyInArrow(pack, kinds).write.mode("overwrite").parquet(root)
    return VectorIndex(root, id_kind, within is not None)


def _centres(held: DataFrame, total: int, wanted: int) -> dict[int, np.ndarray]:
    share = max(1, -(-total // SAMPLE))
    rows = held.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").limit(2 * SAMPLE).toArrow()
    out = {}
    for d, (_, x) in _units(rows.column("v")).items():
        picked, near = [x[0]], 2 - 2 * (x @ x[0])
        while len(picked) < min(wanted, CELLS) and near.max() > 1e-9:
            picked.append(x[near.argmax()])
            near = np.minimum(near, 2 - 2 * (x @ picked[-1]))
        out[d] = np.array(picked)
    return out


def _in_cells(held: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for d, (at, x) in _units(pa.chunked_array([batch.column("v")])).items():
                if d in centres:
                    cell[at] = (x @ centres[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return held.mapInArrow(run, held.schema.simpleString()[7:-1] + ",cell:int")


class _Chunk:
    """Query rows in memory and their best requirements so far."""

    def __init__(self, rows: pa.Table, k: int, threshold: float, id_type: pa.DataType):
        self.rows, self.k, self.units = rows, k, _units(rows.column("v"))
        self.groups = rows.column("g").combine_chunks()
        self.top = np.full((rows.num_rows, k), -np.inf)  # the best scores, unordered
        self.floor = np.full(rows.num_rows, threshold)
        self.row, self.score, self.ids, self.id_type, self.size = [], [], [], id_type, 0
        self.of: dict = {}

    def places(self, g: pa.Scalar, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a group and dimension, and their unit vectors."""
        if (g, d) not in self.of:
            at, x = self.units.get(d, (np.zeros(0, dtype=np.int64), np.zeros((0, d))))
            mine = pc.fill_null(pc.equal(self.groups, g), False).to_numpy(zero_copy_only=False)[at]
            self.of[g, d] = at[mine], x[mine]
        return self.of[g, d]

    def take(self, block: dict, rows: np.ndarray, x: np.ndarray) -> None:
        d, k = block["d"].as_py(), self.k
        matrix = np.frombuffer(block["vectors"].as_buffer(), dtype=np.float64).reshape(-1, d)
        for on in range(0, len(rows), 1024):
            at = rows[on : on + 1024]
            s = np.round(x[on : on + 1024] @ matrix.T, 6)
            low = self.floor[at]
            if s.shape[1] > k:
                best = -np.partition(-s, k - 1, axis=1)[:, :k]
                low = np.maximum(low, best.min(axis=1))
            else:
                best = s
            i, j = np.nonzero(s >= low[:, None])
            self.row.append(at[i])
            self.score.append(s[i, j])
            self.ids.append(block["ids"].values.take(pa.array(j)))
            self.size += len(i)
            both = np.concatenate([self.top[at], best], axis=1)
            self.top[at] = -np.partition(-both, k - 1, axis=1)[:, :k]
            self.floor[at] = np.maximum(self.floor[at], self.top[at].min(axis=1))
        if self.size > 4 * self.top.size + 100_000:
            self.table()

    def table(self) -> pa.Table:
        """row, score and id of the best so far: greatest scores, ties to the smaller id."""
        found = pa.table({"row": pa.array(np.concatenate(self.row or [np.zeros(0, np.int64)]), pa.int64()), "score": pa.array(np.concatenate(self.score or [np.zeros(0)]), pa.float64()), "id": pa.chunked_array(self.ids, self.id_type)})
        found = found.sort_by([("row", "ascending"), ("score", "descending"), ("id", "ascending")])
        row = found.column("row").to_numpy()
        found = found.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < self.k))
        self.row, self.score, self.ids, self.size = [found.column("row").to_numpy()], [found.column("score").to_numpy()], [found.column("id").combine_chunks()], found.num_rows
        return found


def nearest(queries: DataFrame, requirements: DataFrame | VectorIndex, carry: list[str], k: int, threshold: float, block: int = BLOCK, within: str | None = None, chunk: int = CHUNK, probes: int | None = None) -> DataFrame:
    """The ``k`` requirements of greatest cosine (at least ``threshold``) for each query row; columns ``carry`` come along.

    ``requirements`` is a table or an index made of it. With ``within``, a column of both, only requirements with the
    query's value are compared. Scores are rounded to six places; ties go to the smaller id. Null, zero and misfit
    vectors match nothing; rows are taken one by one, also under one id.

    Query rows are never shuffled or copied: a task reads them ``chunk`` at a time and walks over the blocks. Of a block
    only queries are multiplied that it can improve: no cosine exceeds that with the block's centre (not scaled to one)
    plus its radius. With ``probes`` the search is approximate: a query looks only at that many blocks of its group,
    those whose centres are nearest, which loses few neighbours where vectors lie in clusters.
    """
    index = requirements if isinstance(requirements, VectorIndex) else build_index(requirements, within, block)
    group = F.col(within) if within else F.lit(0)
    asked = queries.select(*carry, "v", group.alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    id_type = to_arrow_type(index.id_kind)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        one = _Chunk(rows, k, threshold, id_type)
        groups = pc.unique(one.groups)
        chosen: dict[int, set] = {}
        if probes is not None:
            chosen = _probed(one, index, groups, probes)
        for no, b in enumerate(index.blocks(groups, ["g", "d", "ids", "vectors", "centre", "radius"])):
            at, x = one.places(b["g"], b["d"].as_py())
            reach = x @ np.frombuffer(b["centre"].as_buffer(), dtype=np.float64) + b["radius"].as_py() + 1e-6
            able = reach >= one.floor[at]
            if probes is not None:
                able = np.isin(at, chosen.get(no, []))
            if able.any():
                one.take(b, at[able], x[able])
        found = one.table()
        out = rows.select(carry).take(found.column("row"))
        out = out.append_column("requirement_id", found.column("id")).append_column("similarity_score", found.column("score"))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from compare(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from compare(pa.Table.from_batches(held))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", requirement_id {index.id_kind.simpleString()}, similarity_score double"
    return asked.mapInArrow(run, schema)


def _probed(one: _Chunk, index: VectorIndex, groups: pa.Array, probes: int) -> dict[int, np.ndarray]:
    """For each block, by its place in the index, the rows that look at it."""
    by: dict = {}
    for no, b in enumerate(index.blocks(groups, ["g", "d", "centre"])):
        by.setdefault((b["g"], b["d"].as_py()), []).append((no, np.frombuffer(b["centre"].as_buffer(), dtype=np.float64)))
    out: dict[int, list] = {}
    for (g, d), blocks in by.items():
        at, x = one.places(g, d)
        if not len(at):
            continue
        centres = np.array([c / max(np.linalg.norm(c), 1e-12) for _, c in blocks])
        s = x @ centres.T
        best = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
        for j, (no, _) in enumerate(blocks):
            out[no] = at[(best == j).any(axis=1)]
    return out


def similarity_mappings(evidence: DataFrame, requirements: DataFrame | VectorIndex, k: int = 5, threshold: float = 0.0, probes: int | None = None) -> DataFrame:
    """Proposed mappings: organization_id, evidence_id, requirement_id, similarity_score, status pending. Exact without ``probes``."""
    found = nearest(evidence, requirements, ["organization_id", "evidence_id"], k, threshold, probes=probes)
    return found.withColumn("status", F.lit("pending"))


def cosine(a, b):
    """Cosine of two array columns, by Spark's own functions: a check for small inputs, and null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def versioned_retrieval(queries: DataFrame, versions: DataFrame, requirements: DataFrame, evidence_scope: DataFrame | None = None, k: int = 5, threshold: float = -1.0) -> DataFrame:
    """For queries (query_id, organization_id, framework_id, as_of, v): the ``k`` nearest requirements of the version that held then.

    ``requirements`` has requirement_id, version_id and v; ``evidence_scope`` (organization_id) keeps the queries
    of these tenants only. Each query is compared with the vectors of its own version.
    """
    if evidence_scope is not None:
        queries = queries.join(evidence_scope.select("organization_id"), "organization_id", "left_semi")
    held = version_as_of(queries, versions).where("version_id IS NOT NULL").select("framework_id", "as_of", "version_id")
    asked = queries.join(held, ["framework_id", "as_of"])
    needed = requirements.join(held.select("version_id").distinct(), "version_id", "left_semi")
    return nearest(asked, needed, ["query_id", "organization_id", "version_id"], k, threshold, within="version_id")
