"""Tables that grow with the facts are not broadcast whole, however small their files are."""

import re

import __spark_entry__
import pytest


@pytest.mark.parametrize("name", ["audit_unique", "audit_foreign_keys", "requirement_mappings", "entity_edges"])
def test_orders_are_not_broadcast(spark, small, name):
    plan = __spark_entry__.queries()[name](spark, small)._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+) \[l_orderkey#\w+\], \[o_orderkey#\w+\], Inner", plan)
    assert joins and set(joins) == {"SortMergeJoin"}


def test_small_files_alone_are_broadcast_uncounted(spark, small):
    from dossier.standin import SMALL_FILE, Standin

    Standin(spark, small)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == SMALL_FILE
