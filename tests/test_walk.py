"""Walks over the entity graph read what the frontier needs, and no more."""

import random

import __spark_entry__
import pytest
from dossier.operators import relations
from dossier.standin import Standin


def test_walk_writes_nodes_and_not_edges(spark, small, monkeypatch):
    rows, put = [], relations.checkpointed

    def counted(df):
        out = put(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(relations, "checkpointed", counted)
    found = __spark_entry__.queries()["k_hop"](spark, small).count()
    assert sum(rows) == found > 100  # with the edges dealt by node it was many times that


@pytest.mark.parametrize("most", [relations.FRONTIER_ROWS, 0])
def test_tables_and_edge_list_are_walked_alike(spark, monkeypatch, most):
    monkeypatch.setattr(relations, "FRONTIER_ROWS", most)
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    made = {
        "evidence": [(some(40), some(9)) for _ in range(60)],
        "mappings": [(some(40), some(9), some(15)) for _ in range(50)],
        "versions": [(some(5), some(3)) for _ in range(8)],
        "requirements": [(str(some(15)), some(5)) for _ in range(12)],
    }
    columns = {"evidence": "id long, organization_id int", "mappings": "evidence_id long, organization_id int, requirement_id long", "versions": "id int, framework_id int", "requirements": "id string, version_id int"}
    tables = {t: spark.createDataFrame(rows, columns[t]) for t, rows in made.items()}
    beside = {}
    for a, _, b, t, x, y in relations.RELATIONS:
        names = [c.split(" ")[0] for c in columns[t].split(", ")]
        for row in made[t]:
            p, q = row[names.index(x)], row[names.index(y)]
            if p is not None and q is not None:
                beside.setdefault((a, str(p)), set()).add((b, str(q)))
                beside.setdefault((b, str(q)), set()).add((a, str(p)))
    for seeds in ([("version", "1"), ("requirement", "3")], [("organization", "2"), ("evidence", " 7"), ("evidence", "07"), ("evidence", "1e1"), ("evidence", None), ("other", "1")], [("evidence", "99999999999999999999")], []):
        want, frontier = dict.fromkeys(seeds, 0), set(seeds)
        for hop in range(1, 4):
            frontier = {m for n in frontier if hop == 1 or n[0] != "organization" for m in beside.get(n, ())} - set(want)
            want |= dict.fromkeys(frontier, hop)
        start = spark.createDataFrame(seeds, "type string, id string")
        for graph in (tables, relations.entity_edges(tables), relations.entity_edges(tables, distinct=False)):
            got = relations.k_hop(graph, start, 3).collect()
            assert len(got) == len(want) and {(r.type, r.id): r.hop for r in got} == want


def test_tables_that_link_nothing_reached_are_not_read(spark, small):
    s = Standin(spark, small)
    unread = s.mappings().selectExpr("raise_error('read') AS evidence_id", "organization_id", "requirement_id").selectExpr("CAST(evidence_id AS bigint) AS evidence_id", "organization_id", "requirement_id")
    tables = {"evidence": s.evidence(), "mappings": unread, "versions": s.versions(), "requirements": s.requirements()}
    seeds = spark.createDataFrame([("framework", "1")], "type string, id string")
    got = relations.k_hop(tables, seeds, 2)
    assert {(r.type, r.hop) for r in got.select("type", "hop").distinct().collect()} == {("framework", 0), ("version", 1), ("requirement", 2)}
