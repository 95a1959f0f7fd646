"""A stream whose input has ended gives what its SQL gives, the last minutes included."""

from datetime import datetime, timedelta

import __spark_entry__
import pytest
from compare import check, connection

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def query(spark, tmp_path, rows):
    df = spark.createDataFrame([(e, T0 + timedelta(seconds=s), u, k, 0.0, "") for e, u, k, s in rows], SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return __spark_entry__.queries()["stream_stuck_documents"](spark, str(tmp_path))


@pytest.mark.parametrize("seed", [0, 1])
def test_stuck_documents_that_the_last_minutes_end(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    rows = [(0, 1, "view", 0), (1, 1, "purchase", 2000), (2, 2, "view", 100), (3, 2, "view", 2300), (4, 3, "view", 1700), (5, 3, "error", 2390), (6, 4, "error", 2400), (7, 5, "view", -5000)]
    if seed:
        rows = [(k, rng.randint(1, 40), rng.choice(["view", "click", "purchase", "error", "signup"]), rng.randint(0, 9000)) for k in range(200)]
    got = query(spark, tmp_path, rows)
    check(got, connection(str(tmp_path)), __spark_entry__.oracle_sql()["stream_stuck_documents"])
    assert got.count() >= 3


def test_no_event_gives_no_stuck_document(spark, tmp_path):
    assert query(spark, tmp_path, []).count() == 0
