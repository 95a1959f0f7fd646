"""Mutations, extraction, audits and plans on hand-made rows."""

from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import audit, extract, lookup, mutate, relations, similarity
from dossier.plans import coverage, versions
from dossier.sources.objects import read_objects
from dossier.sources.tables import create_tables, read_table, write_table

T0, T1 = datetime(2024, 1, 1), datetime(2024, 6, 1)


def at_noon():
    return F.expr("TIMESTAMP '2024-06-01'")




def test_process_documents(spark):
    def pdf(content):
        if content == b"bad":
            raise ValueError("broken file")
        return [p for p in content.decode().split("|") if p], 3

    tasks = spark.createDataFrame([("1", "a.pdf"), ("2", "b.txt"), ("3", "gone.txt"), ("4", "x.md"), ("5", "bad.pdf"), ("6", "c.docx"), ("7", None)], "document_id string, file_path string")
    objects = spark.createDataFrame([("a.pdf", b"p one||p two"), ("b.txt", b"x \xff y"), ("x.md", b"m"), ("bad.pdf", b"bad"), ("c.docx", b"d")], "file_path string, content binary")
    done = extract.process_documents(tasks, objects, {"pdf": pdf})
    got = {r.document_id: r for r in done.collect()}
    assert (got["1"].status, got["1"].extracted_text, got["1"].page_count, got["1"].word_count) == ("COMPLETED", "p one\np two", 3, 4)
    assert (got["2"].extracted_text, got["2"].page_count, got["2"].word_count) == ("x  y", 1, 2)
    assert [got[k].status for k in "34567"] == ["FAILED"] * 5
    assert got["4"].error == "Unsupported file extension: .md" and got["5"].error == "broken file" and got["3"].error.endswith("gone.txt")
    result = {r.document_id: r for r in extract.process_result(done).collect()}
    assert result["2"].text_length == 4 and result["2"].error is None and result["5"].page_count is None


def test_default_extractors_fail_alone(spark):
    tasks = spark.createDataFrame([("1", "a.pdf"), ("2", "b.txt")], "document_id string, file_path string")
    objects = spark.createDataFrame([("a.pdf", b"%PDF"), ("b.txt", b"x")], "file_path string, content binary")
    got = {r.document_id: r.status for r in extract.process_documents(tasks, objects).collect()}
    assert got == {"1": "FAILED", "2": "COMPLETED"}


def test_assemble(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, ""), (1, 3, None), (1, 4, "d"), (2, 1, "")], "document_id int, page_no int, page_text string")
    assert {(r.document_id, r.text, r.page_count) for r in extract.assemble_pages(pages).collect()} == {(1, "b\nd", 4), (2, "", 1)}
    assert {(r.document_id, r.text, r.page_count) for r in extract.assemble_paragraphs(pages).collect()} == {(1, "\nb\n\nd", 1), (2, "", 1)}


def test_apply_status_updates(spark):
    artifacts = spark.createDataFrame([("a", "PENDING", "old", 1, 1, T0), ("b", "PENDING", None, None, None, T0), ("c", "FAILED", "t", None, None, T0)], "id string, status string, extracted_text string, page_count int, word_count int, updated_at timestamp")
    updates = spark.createDataFrame([("a", "COMPLETED", "", 0, None, 1), ("a", "FAILED", None, None, None, 2), ("x", "COMPLETED", "t", 1, 1, 1), (None, "FAILED", None, None, None, 1), ("c", "FAILED", None, None, None, 1)], "id string, status string, extracted_text string, page_count int, word_count int, ts int")
    table, report = mutate.apply_status_updates(artifacts, updates, at_noon())
    got = {r.id: r for r in table.collect()}
    assert (got["a"].status, got["a"].extracted_text, got["a"].page_count, got["a"].word_count, got["a"].updated_at) == ("FAILED", "", 0, 1, T1)
    assert got["b"].status == "PENDING" and got["b"].updated_at == T0 and got["c"].updated_at == T0 and len(got) == 3
    assert {(r.id, r.applied) for r in report.collect()} == {("a", True), ("x", False), (None, False), ("c", True)}


def test_update_rows(spark):
    df = spark.createDataFrame([(1, "x", "y", T0), (2, "x", None, T0), (3, "x", "z", T0)], "id int, a string, b string, updated_at timestamp")
    patch = spark.createDataFrame([(1, None, "q"), (2, None, "q"), (9, "n", "q")], "id int, b string, unknown string")
    got = {r.id: (r.a, r.b, r.updated_at) for r in mutate.update_rows(df, patch, at_noon()).collect()}
    assert got == {1: ("x", None, T1), 2: ("x", None, T0), 3: ("x", "z", T0)}


def test_create_rows(spark):
    old = spark.createDataFrame([("1", "f", "v1", None, None, True, T0, T0)], schemas.SCHEMAS["regulatory_versions"])
    new = spark.createDataFrame([("2", "f", "v1", None), ("3", "f", "v2", None), ("4", "f", "v2", False), ("5", "g", "v1", False)], "id string, framework_id string, version_slug string, is_active boolean")
    created, rejected = mutate.create_rows(old, new, "regulatory_versions", at_noon())
    assert {(r.id, r.is_active, r.created_at) for r in created.collect()} == {("3", True, T1), ("5", False, T1)}
    assert {r.id for r in rejected.collect()} == {"2", "4"}


def tree(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    return {
        "organizations": make([(1,), (2,)], "id int"), "evidence_artifacts": make([(10, 1), (11, 2)], "id int, organization_id int"),
        "compliance_mappings": make([(100, 1, 10, 1000), (101, 2, 11, 1000), (102, 2, 11, None)], "id int, organization_id int, evidence_id int, requirement_id int"),
        "regulatory_frameworks": make([(5,)], "id int"), "regulatory_versions": make([(50, 5)], "id int, framework_id int"), "regulatory_requirements": make([(1000, 50), (1001, 50)], "id int, version_id int"),
    }


@pytest.mark.parametrize(("table", "ids", "mode", "left"), [("organizations", [1, 7], "orm", {"organizations": 1, "evidence_artifacts": 1, "compliance_mappings": 2}), ("regulatory_frameworks", [5], "orm", {"regulatory_versions": 0, "regulatory_requirements": 0, "compliance_mappings": 1}), ("evidence_artifacts", [11], "orm", {"evidence_artifacts": 1, "compliance_mappings": 1}), ("regulatory_requirements", [1000], "db", {"regulatory_requirements": 1, "compliance_mappings": 3})])
def test_delete(spark, table, ids, mode, left):
    out, report = mutate.delete_cascade(tree(spark), table, spark.createDataFrame([(i,) for i in ids], "id int"), mode)
    assert {k: out[k].count() for k in left} == left
    assert {(r.id, r.deleted) for r in report.collect()} == {(i, i != 7) for i in ids}
    if mode == "db":
        assert out["compliance_mappings"].where("requirement_id IS NULL").count() == 3


def test_landing_and_status(spark):
    up = spark.createDataFrame([("k", 1, T0), ("k", 2, T1), ("k", 3, T1), ("j", 4, None), (None, 5, T0)], "file_path string, upload_id int, uploaded_at timestamp")
    assert {r.upload_id for r in mutate.land_objects(up).collect()} == {3, 4}
    docs = spark.createDataFrame([("a", "completed", "text", 1, 1), ("b", None, "text", None, None)], "id string, status string, extracted_text string, page_count int, word_count int")
    got = {r.document_id: r for r in mutate.document_status(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), docs).collect()}
    assert got["a"].text_preview == "text" and got["b"].status == "PENDING" and not got["c"].found and got["c"].message == "Document with ID 'c' not found."
    rows = spark.createDataFrame([("a", "PROCESSING", T0), ("b", "PROCESSING", T1), ("c", "FAILED", T0)], "id string, status string, updated_at timestamp")
    assert [r.id for r in mutate.stuck_documents(rows, at_noon()).collect()] == ["a"]


def test_lookup_nulls_and_pages(spark):
    df = spark.createDataFrame([(1, "a", T1), (2, "a", T0), (3, None, T0)], "id int, organization_id string, created_at timestamp")
    keys = spark.createDataFrame([("a",), (None,), ("a",)], "organization_id string")
    assert {r.id for r in lookup.rows_by_key(keys, df, ["organization_id"]).collect()} == {1, 2}
    assert [r.id for r in lookup.first_per_key(keys, df, ["organization_id"]).collect()] == [2]
    assert [r.id for r in lookup.list_page(df, 1, 1).collect()] == [3]
    assert [r.id for r in lookup.list_by_organization(df, "a", 1, 5).collect()] == [1]
    assert [r.id for r in lookup.list_after(df, F.lit(T0), F.lit(2)).collect()] == [3, 1]


def test_audits(spark):
    t = tree(spark)
    bad = spark.createDataFrame([(1, "x" * 300, None), (1, None, "odd")], "id int, name string, status string")
    assert {(r.rule, r.key, r.n_violations) for r in audit.audit_unique({"t": bad}, {"t": (("id",), ("name",))}).collect()} == {("unique(id)", "1", 2)}
    assert {(r.key, r.n_violations) for r in audit.audit_not_null({"t": bad}, {"t": ["id", "name"]}).collect()} == {("name", 1)}
    assert {(r.key, r.n_violations) for r in audit.audit_lengths({"t": bad}, {"t": {"name": 255}}).collect()} == {("name", 1)}
    assert {(r.key, r.n_violations) for r in audit.audit_status_domain({"t": bad}, {"t": schemas.EVIDENCE_STATUSES}).collect()} == {("odd", 1)}
    assert audit.audit_foreign_keys(t, {**{n: r.foreign for n, r in schemas.RULES.items()}}).count() == 0
    stray = t["compliance_mappings"].union(spark.createDataFrame([(103, 1, 11, 77)], t["compliance_mappings"].schema))
    assert {(r.rule, r.key) for r in audit.audit_foreign_keys({**t, "compliance_mappings": stray}).collect()} == {("foreign_key(requirement_id)", "77")}
    assert {(r.key, r.n_violations) for r in audit.audit_tenant_isolation(stray, t["evidence_artifacts"]).collect()} == {("1", 1)}


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, "a", date(2020, 1, 1), True), (2, 1, "b", date(2021, 1, 1), False), (3, 1, "c", None, True), (4, 1, "d", date(2020, 1, 1), True)], "id int, framework_id int, version_slug string, publication_date date, is_active boolean")
    asked = spark.createDataFrame([(1, date(2019, 1, 1)), (1, date(2022, 1, 1)), (2, date(2022, 1, 1))], "framework_id int, as_of date")
    assert {(r.framework_id, r.as_of.year, r.version_id) for r in versions.version_as_of(asked, v).collect()} == {(1, 2019, None), (1, 2022, 4), (2, 2022, None)}
    r = spark.createDataFrame([(1, 10, "A", "t", None), (2, 10, "B", "t", None), (3, 10, "C", "t", "d"), (4, 20, "A", "t", None), (5, 20, "C", "t", None), (6, 20, "D", "t", None)], "id int, version_id int, code string, title string, description string")
    diff = versions.version_diff(r, spark.createDataFrame([(10, 20)], "old_version_id int, new_version_id int"))
    assert {(x.code, x.change) for x in diff.collect()} == {("A", "unchanged"), ("B", "removed"), ("C", "modified"), ("D", "added")}
    m = spark.createDataFrame([(7, 70, 1, 0.5, "approved"), (7, 71, 2, 0.5, "approved"), (7, 72, 3, None, "approved")], "organization_id int, evidence_id int, requirement_id int, similarity_score double, status string")
    assert {(x.requirement_id, x.status) for x in versions.carry_forward(diff, m).collect()} == {(4, "approved"), (5, "pending")}
    assert {(x.change, x.requirements) for x in versions.change_impact(diff, m).collect()} == {("removed", 1), ("modified", 1)}


def test_coverage_counts_distinct_approved(spark):
    o, v = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(10, 5), (11, 5)], "id int, framework_id int")
    r = spark.createDataFrame([(100, 10), (101, 10)], "id int, version_id int")
    m = spark.createDataFrame([(1, 100, 7, "approved"), (1, 100, 8, "approved"), (1, 101, 7, "pending"), (1, None, 7, "approved")], "organization_id int, requirement_id int, evidence_id int, status string")
    got = {(x.organization_id, x.version_id): (x.total, x.covered, x.ratio) for x in coverage.coverage(o, v, r, m).collect()}
    assert got == {(1, 10): (2, 1, 0.5), (2, 10): (2, 0, 0.0), (1, 11): (0, 0, None), (2, 11): (0, 0, None)}


def test_similarity_blocks_and_zero_vectors(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 0.0]), (1, 3, None)], "organization_id int, evidence_id int, v array<double>")
    r = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(7)], "requirement_id long, v array<double>")
    one = similarity.nearest(e, r, ["organization_id", "evidence_id"], 3, 0.0).collect()
    many = similarity.nearest(e, r, ["organization_id", "evidence_id"], 3, 0.0, block=2).collect()
    assert [x.requirement_id for x in one] == [0, 3, 6] and {tuple(x) for x in one} == {tuple(x) for x in many}
    twice = e.unionByName(spark.createDataFrame([(1, 1, [0.0, 1.0])], "organization_id int, evidence_id int, v array<double>"))
    for block, chunk in ((100, 100), (2, 1)):  # two vectors under one id have their own best three, however both sides are cut
        assert similarity.nearest(twice, r, ["organization_id", "evidence_id"], 3, 0.0, block=block, chunk=chunk).count() == 6
    both = e.crossJoin(r.withColumnRenamed("v", "w")).where("evidence_id = 1").select(F.round(similarity.cosine(F.col("v"), F.col("w")), 6).alias("c")).collect()
    assert max(x.c for x in both) == 1.0


def clustered(spark, n, seed, width=16, clusters=40):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(clusters, width))
    return (centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, width))).tolist()


def test_similarity_index_exact_and_probed(spark):
    """Many blocks, cut along cells: exactly what plain products give; with a few probes nearly so."""
    x, y = clustered(spark, 300, 1), clustered(spark, 4000, 2)
    e = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "organization_id int, evidence_id int, v array<double>")
    r = spark.createDataFrame(list(enumerate(y)), "requirement_id long, v array<double>")
    unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(x) @ unit(y).T, 6)
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(4000), -s[i]))[:5]}
    index = similarity.build_index(r, block=100)
    assert spark.read.parquet(index.root).count() > 20 and sum(len(b.ids) for b in spark.read.parquet(index.root).collect()) == 4000
    got = similarity.similarity_mappings(e, index)
    assert {(v.evidence_id, v.requirement_id) for v in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # queries stay where they are
    near = {(v.evidence_id, v.requirement_id) for v in similarity.similarity_mappings(e, index, probes=3).collect()}
    assert len(near & want) >= 0.95 * len(want)


def test_similarity_skips_blocks(spark, monkeypatch):
    x, y = clustered(spark, 50, 1), clustered(spark, 3000, 2)
    index = similarity.build_index(spark.createDataFrame(list(enumerate(y)), "requirement_id long, v array<double>"), block=100)
    rows = pa.table({"v": pa.array(x), "g": pa.array([0] * 50, pa.int32())})
    one, products = similarity._Chunk(rows, 5, -1.0, pa.int64()), 0
    for b in index.blocks(pa.array([0], pa.int32()), ["g", "d", "ids", "vectors", "centre", "radius"]):
        at, v = one.places(b["g"], b["d"].as_py())
        able = v @ np.frombuffer(b["centre"].as_buffer()) + b["radius"].as_py() >= one.floor[at]
        products += int(able.sum()) * len(b["ids"])
        if able.any():
            one.take(b, at[able], v[able])
    assert products < 0.7 * 50 * 3000


def test_similarity_of_text_ids(spark):
    e = spark.createDataFrame([("o", "e1", "v1", [1.0, 0.1]), ("o", "e2", "v2", [1.0, 0.1])], "organization_id string, evidence_id string, version_id string, v array<double>")
    r = spark.createDataFrame([("r1", "v1", [1.0, 0.0]), ("r2", "v2", [0.0, 1.0]), ("r3", "v2", [1.0, 0.2])], "requirement_id string, version_id string, v array<double>")
    got = similarity.nearest(e, r, ["evidence_id", "version_id"], 1, 0.0, within="version_id").collect()
    assert {(x.evidence_id, x.requirement_id) for x in got} == {("e1", "r1"), ("e2", "r3")}


def test_tables_and_objects(spark, tmp_path):
    root = str(tmp_path / "t")
    create_tables(spark, root)
    assert read_table(spark, root, "compliance_mappings").count() == 0
    write_table(spark.createDataFrame([("1", "n", T0, T0)], "id string, name string, created_at timestamp, updated_at timestamp"), root, "organizations", "append")
    assert read_table(spark, root, "organizations").first()["name"] == "n"
    with pytest.raises(ValueError, match="name"):
        write_table(spark.createDataFrame([("1",)], "id string"), root, "organizations")
    for name in ("a.txt", "d/b c.txt"):
        (tmp_path / "o" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "o" / name).write_bytes(b"x" * len(name))
    assert {r.file_path for r in read_objects(spark, str(tmp_path / "o")).collect()} >= {"a.txt"}
    assert read_objects(spark, str(tmp_path / "o"), max_bytes=5).count() == 1


def test_hubs_are_not_walked_through(spark):
    e = spark.createDataFrame([("organization", "1", "r", "evidence", "10"), ("organization", "1", "r", "evidence", "11"), ("evidence", "10", "r", "requirement", "5")], "src_type string, src_id string, rel string, dst_type string, dst_id string")
    got = {(r.type, r.id): r.hop for r in relations.k_hop(e, spark.createDataFrame([("requirement", "5")], "type string, id string"), 3).collect()}
    assert got == {("requirement", "5"): 0, ("evidence", "10"): 1, ("organization", "1"): 2}


def test_decoding_drops_what_is_malformed(spark):
    import random

    rng = random.Random(3)
    pool = ["a", "é", "日", "🎈", "\ufffd", "\ue000", "0", "1", "\ufeff"]
    cases = [b"", None, b"\xef\xbf", b"\xe2\xef\xbf\xbd", "\ue0001\ufffd\ue0000".encode() + b"\xff"]
    for _ in range(300):
        raw = bytearray("".join(rng.choices(pool, k=12)).encode())
        for _ in range(rng.randint(0, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        cases.append(bytes(raw))
    df = spark.createDataFrame(list(enumerate(cases)), "k int, content binary").select("k", extract.decode_text(F.col("content")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.t for r in df.collect()} == {k: c if c is None else c.decode("utf-8", "ignore") for k, c in enumerate(cases)}


def test_terms_by_automaton_as_by_alternatives(spark):
    import random
    import re

    from dossier.functions import text

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 5)))
    terms = [" ".join(word() for _ in range(rng.choice([1, 1, 2]))) for _ in range(5000)] + ["must not", "must", "§ 5"]
    lines = ["We MUST not. Mustard must", "§ 5 x § 5", "", None, *(" ".join(word() + rng.choice(["", "", "x", "_", ","]) for _ in range(6)).title() for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(lines)), "id int, extracted_text string")
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    plain = re.compile("\\b(" + "|".join(re.escape(lower(t)) for t in terms) + ")\\b")
    want = set()
    for k, line in enumerate(lines):
        for seq, sentence in enumerate(re.split(r"[.!?]\s+|\n", line) if line is not None else []):
            if found := plain.search(lower(sentence)):
                want.add((k, seq, sentence, sentence[found.start() : found.end()]))
    assert {tuple(r) for r in text.extract_obligations(docs, terms).collect()} == want and len(want) > 100
    assert text.extract_obligations(docs, []).count() == 0
    with pytest.raises(ValueError, match="terms"):
        text.extract_obligations(docs, ["x" * (33 << 20)])


def test_sketches_merge_within_their_error(spark):
    m = spark.range(60_000).select((F.col("id") % 3).alias("organization_id"), (F.col("id") % 7919).alias("evidence_id"), (F.col("id") % 50).alias("requirement_id"), F.when(F.col("id") % 2 == 0, 0.5).alias("similarity_score"), F.lit("approved").alias("status"))
    r = spark.range(50).select("id", (F.col("id") % 5).alias("version_id"))
    sketches = coverage.mapping_sketches(m, r)
    for by in ((), ("organization_id",), ("organization_id", "version_id")):
        exact = m.join(r.withColumnRenamed("id", "requirement_id"), "requirement_id").groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("e"))
        got = {tuple(x[c] for c in by): x for x in coverage.merged_sketches(sketches, *by).collect()}
        for x in exact.collect():
            y = got[tuple(x[c] for c in by)]
            assert y.approved == x.n and y.pending == 0 and y.mean_similarity == 0.5 and abs(y.evidence - x.e) <= 3 * coverage.SKETCH_ERROR * x.e + 1


def test_version_as_of_has_no_join(spark):
    v = spark.createDataFrame([(k, k % 3, f"v{k}", date(2000 + k // 3, 1, 1), True) for k in range(60)] + [(99, None, "n", date(2000, 1, 1), True)], "id int, framework_id int, version_slug string, publication_date date, is_active boolean")
    asked = spark.createDataFrame([(k % 4, date(1995 + k, 6, 1)) for k in range(30)] + [(None, date(2010, 1, 1)), (1, None), (1, None)], "framework_id int, as_of date")
    found = versions.version_as_of(asked, v)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.framework_id, r.as_of): r.version_id for r in found.collect()}
    held = [(f, d, i) for i, f, _, d, _ in [tuple(r) for r in v.collect()]]
    assert got == {(f, a): max(((d, i) for g, d, i in held if g == f and a is not None and f is not None and d <= a), default=(None, None))[1] for f, a in {(r.framework_id, r.as_of) for r in asked.collect()}}


def test_contents_land_where_they_lie(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [(f"k{rng.randint(0, 3000)}" if rng.random() > 0.01 else None, k, T0 if rng.random() < 0.5 else T1 if rng.random() < 0.9 else None, f"content {k}".encode()) for k in range(70_000)]
    spark.createDataFrame(rows, "file_path string, upload_id int, uploaded_at timestamp, content binary").coalesce(2).write.parquet(str(tmp_path / "up"))
    spark.createDataFrame([("k1", 10**6 + k, T1, b"tie") for k in (5, 5)], "file_path string, upload_id int, uploaded_at timestamp, content binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "up"))
    uploads = spark.read.parquet(str(tmp_path / "up"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        landed = mutate.land_objects(uploads)
        plan = landed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        got = {r.file_path: (r.upload_id, bytes(r.content)) for r in landed.collect()}
        assert landed.count() == len(got) and landed.columns == uploads.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {}
    for key, k, at, content in [*rows, ("k1", 10**6 + 5, T1, b"tie")]:
        if key is not None and (key not in want or (at is not None, at or T0, k) > want[key][:3]):
            want[key] = (at is not None, at or T0, k, content)
    assert got == {key: v[2:] for key, v in want.items()}


def test_walk_from_a_hub(spark):
    """A seed of a type that is not walked through is expanded all the same; repeated edges change nothing."""
    e = spark.createDataFrame([("organization", "1", "r", "evidence", "10"), ("organization", "1", "r", "evidence", "10"), ("organization", "2", "r", "evidence", "11"), ("evidence", "10", "r", "requirement", "5"), ("evidence", "11", "r", "requirement", "5")], "src_type string, src_id string, rel string, dst_type string, dst_id string")
    walk = lambda t, i, k: sorted((r.hop, r.type, r.id) for r in relations.k_hop(e, spark.createDataFrame([(t, i)], "type string, id string"), k).collect())
    assert walk("organization", "1", 9) == [(0, "organization", "1"), (1, "evidence", "10"), (2, "requirement", "5"), (3, "evidence", "11"), (4, "organization", "2")]
    assert walk("framework", "7", 2) == [(0, "framework", "7")]
