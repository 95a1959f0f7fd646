"""Memory of the Python workers: bounded by constants, not by how long the texts of ten thousand rows are."""

import tracemalloc

import numpy as np
import pyarrow as pa
from dossier.llm import neardup, shared
from pyspark.sql import functions as F


def test_signatures_take_rows_by_bytes(spark):
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 4000).alias("text"))
    neardup.near_duplicates(docs.limit(4))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "n"])

    seen = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in seen) == 600 and max(r.bytes for r in seen) < 8 << 20


def test_numpy_passes_of_signatures_are_small():
    draw = np.random.default_rng(5)
    texts = [" ".join(map(str, draw.integers(0, 10**6, 400))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["text"])
    shared._powers.clear()
    tracemalloc.start()
    for piece in neardup.pieces([batch], "text", getattr(neardup, "TEXTS_AT_ONCE", shared.PIECE_BYTES)):
        for _ in neardup.shingle_sets(piece.column("text"), 5):
            pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20, most >> 20
