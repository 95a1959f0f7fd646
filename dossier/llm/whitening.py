"""Whitening of embeddings with MLlib's BlockMatrix: scatter by a product of blocks, eigenvectors here, projection by a product of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dossier.llm.shared import Scratch, written

#: Numbers in a block of rows, at least and at most. In between, a matrix has about ``BLOCKS`` blocks of rows.
LEAST, MOST, BLOCKS = 1 << 17, 1 << 22, 4096
#: Most dimensions: the scatter matrix (their square) is one block and comes to the driver.
WIDEST = 4096
#: Components with a smaller share of the greatest eigenvalue have no variance to speak of.
FLAT = 1e-12


def finite(vector: Column) -> Column:
    """Vectors that are there and have no null, NaN or infinite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


@dataclass
class Whitening:
    """What was learned: rows, exact sums by dimension, eigenvalues of the covariance (falling), its trace, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    vectors: np.ndarray

    def flat(self) -> np.ndarray:
        return self.values <= FLAT * self.values.max(initial=0.0)


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` written, with a column ``place`` from 0 without gaps. The driver sees one count for each written partition."""
    rows = scratch.written(df.withColumn("__id", F.monotonically_increasing_id()), "rows").withColumn("__part", F.shiftright("__id", 33))
    counts = rows.groupBy("__part").count().orderBy("__part").collect()
    upto = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    starts = df.sparkSession.createDataFrame([(r["__part"], s) for r, s in zip(counts, upto, strict=False)], "__part long, __start long")
    return rows.join(starts, "__part").withColumn("place", F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__id")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums by dimension; a row for each dimension and batch is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if len(x):
                small = np.abs(x.astype(np.float64)).max() < 2.0**40
                s = x.sum(axis=0, dtype=np.int64 if small else object).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(v) for v in s])], names=["dim", "s"])

    parts = rows.select("x").mapInArrow(run, "dim int, s string")
    found = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(found, key=lambda r: r.dim)]


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """id, place, x, ``deviation`` (exact) and ``centred``: n * x - sum in whole numbers, divided by n once."""
    id_type, width = to_arrow_type(rows.schema["id"].dataType), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            gap = n * x.astype(object) - np.array(sums, dtype=object)
            most = max(map(abs, gap.ravel()), default=0)
            if most * most * width < 2**62:
                gap = gap.astype(np.int64)
            deviation = pa.array([str(v) for v in (gap * gap).sum(axis=1)], pa.string())
            centred = pa.array(gap.astype(np.float64).ravel() / n)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), batch.column("place"), batch.column("x"), deviation, pa.ListArray.from_arrays(ends, centred)], names=["id", "place", "x", "deviation", "centred"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "place", "x").mapInArrow(run, f"id {kind}, place long, x array<long>, deviation string, centred array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product; its inner dimension is dealt to ``splits`` tasks, so that no task gets all blocks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _learned(matrix: BlockMatrix, n: int, sums: list[int], blocks: int) -> Whitening:
    scatter = _product(matrix.transpose(), matrix, blocks).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), float(np.trace(covariance)), vectors[:, ::-1])


def _projected(spark: SparkSession, matrix: BlockMatrix, learned: Whitening, keep: int) -> DataFrame:
    """(place, whitened): rows times the eigenvectors over the roots of their eigenvalues."""
    flat = learned.flat()[:keep]
    turn = learned.vectors[:, :keep] / np.sqrt(np.where(flat, 1.0, learned.values[:keep]))
    local = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(len(learned.sums), keep, turn.ravel("F")))], 1), len(learned.sums), keep)
    rows = callMLlibFunc("getIndexedRows", _product(matrix, local, 1).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    values = vector_to_array("vector")
    return rows.select(F.col("index").alias("place"), F.array(*(F.lit(None).cast("double") if f else values[i] for i, f in enumerate(flat))).alias("whitened"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "x", components: int | None = None) -> tuple[DataFrame, Whitening]:
    """(one row for each vector that takes part, what was learned), from rows (id, array of whole numbers).

    Rows returned: the id, ``x``, ``deviation`` (decimal: over all dimensions the sum of (n * x - sum) ** 2, exact) and
    ``whitened`` (the first ``components`` values by falling eigenvalue; null where a component has no variance). Sums
    are exact and rows are centred before anything is multiplied, so that a large common offset costs no digits; the
    covariance's divisor is n. Null or empty arrays and those with a null take no part. Ids may be null or repeated.
    Arrays of several sizes have no covariance and raise ``ValueError``. Without rows the result is empty.
    """
    spark, scratch, kind = rows.sparkSession, Scratch(rows.sparkSession), rows.schema[id_col].dataType.simpleString()
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<long>").alias("x")).where("size(x) > 0 AND NOT exists(x, c -> c IS NULL)")
    data = scratch.written(numbered(kept, scratch), "places")
    n, width, high = data.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        scratch.clear()
        return spark.createDataFrame([], f"{id_col} {kind}, x array<long>, deviation decimal(38,0), whitened array<double>"), Whitening(0, [], np.zeros(0), 0.0, np.zeros((0, 0)))
    if width != high or high > WIDEST:
        raise ValueError(f"vectors have {width} to {high} dimensions; they need one number, {WIDEST} at most")
    sums = _sums(data, width)
    data = scratch.written(_centred(data, n, sums), "centred")
    per_block = int(np.clip(-(-n // BLOCKS), max(1, LEAST // width), max(1, MOST // width)))
    vectors = MLUtils.convertVectorColumnsFromML(data.select(F.col("place").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    matrix = IndexedRowMatrix(vectors, n, width).toBlockMatrix(per_block, width)
    learned = _learned(matrix, n, sums, -(-n // per_block))
    projected = _projected(spark, matrix, learned, min(width, components or width))
    out = written(data.join(projected, "place").select(F.col("id").alias(id_col), "x", "deviation", "whitened"), "whitened")
    scratch.clear()
    return out, learned


def identity_error(whitened: DataFrame, learned: Whitening, components: int) -> float | None:
    """The largest entry by which the covariance of ``whitened`` (divisor n) misses the identity; components without variance do not count."""
    of = [i for i, flat in enumerate(learned.flat()[:components]) if not flat]
    if not of:
        return None
    w = {i: F.col("whitened")[i] for i in of}
    means = whitened.agg(*(F.avg(w[i]) for i in of)).first()
    off = {i: w[i] - F.lit(m) for i, m in zip(of, means, strict=True)}
    pairs = [(i, j) for i in of for j in of if i <= j]
    found = whitened.agg(*(F.avg(off[i] * off[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))
