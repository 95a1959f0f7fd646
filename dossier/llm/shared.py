"""What the operators of this subpackage share: tables in the shared folder, and words of Arrow texts.

Words are maximal runs of characters outside ``\\x20\\x09-\\x0D`` (``WORD``). All such separators are
single bytes in UTF-8, so words are found in the bytes of a whole Arrow column at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all operators, as a regular expression of Java, Python and SQL alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass handles at most (one longer text is a pass of its own).
PIECE_BYTES = 4 << 20

#: Bytes of rows that go to a Python worker at once, where a job keeps batches small.
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local one in local mode only; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-dossier-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/dossier-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that a job needs for a while: ``written`` makes one, ``clear`` deletes all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths = []


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers ``BATCH_BYTES`` at a time, not 10,000 of them however long; what the session sets itself stays."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(most, None) is None:
        spark.conf.set(most, BATCH_BYTES)


def word_count(text) -> F.Column:
    """Words of a text as a column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about ``size`` bytes at most."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and where each text begins and ends (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


class Words:
    """The words of a column: ``start`` and ``end`` in ``data``; text ``k`` has the words ``first[k]:first[k + 1]``.

    ``apart``: which bytes separate words, if not white space (ASCII bytes only).
    """

    def __init__(self, column: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE):
        self.data, self.offsets = text_bytes(column, lower)
        n = len(self.data)
        inside = ~apart[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[self.offsets < n]] = False
        after[self.offsets[self.offsets > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(n, base % 2**64, dtype=np.uint64)
        steps[:1] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each byte range ``start:end`` (in order): a polynomial modulo 2**64, taken from running sums, then mixed.

    It depends on the bytes only, and so is the same in every task.
    """
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, low + block)))
        high = int(end[to - 1])
        n = high - low
        up, down = _power("up", _BASE, n + 1), _power("down", pow(_BASE, -1, 2**64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * up[s]
        at = to
    return mix64(out)


def windows_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` word hashes; the window at i is words i to i + k - 1."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix64(out)
