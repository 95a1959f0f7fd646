"""Search by inner product, whitening and spelling variants, against plain numpy and Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import covertree, spelling, whitening
from dossier.llm import queries as q
from dossier.llm.shared import Scratch


def nearest(rows, query, k):
    """(query id, rank, id, score) by plain products; rows (id, vector)."""
    rows = [(i, v) for i, v in rows if v is not None and None not in v]
    out = Counter()
    for at, (i, v) in enumerate(rows):
        if i is not None and query(i):
            s = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for to, (j, w) in enumerate(rows) if to != at and len(w) == len(v)]
            out.update((i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(s, key=lambda x: x[:3])[:k]))
    return out


def clustered(n, width, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-4000, 4000, (clusters, width))
    return (centres[rng.integers(0, clusters, n)] + rng.integers(-30, 30, (n, width))).tolist()


def test_cover_tree():
    x = np.array(clustered(3000, 5, 1))
    t = covertree.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(3000)) and (t.x == x[t.order]).all() and len(t.start) > 6
    for k, kids in enumerate(t.children):
        assert np.sqrt(((t.x[t.start[k] : t.end[k]] - t.centre[k]) ** 2).sum(axis=1)).max() <= t.radius[k]
        if kids:
            spans = sorted((t.start[c], t.end[c]) for c in kids)
            assert spans[0][0] == t.start[k] and spans[-1][1] == t.end[k] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_node_pairs_are_pruned(monkeypatch):
    x = np.array(clustered(2000, 8, 2, 20))
    seen = []
    monkeypatch.setattr(covertree.Best, "_take", lambda self, at, scores, ids, rows, take=covertree.Best._take: (seen.append(scores.size), take(self, at, scores, ids, rows)))
    best = covertree.Best(covertree.cover_tree(x[:200]), np.arange(200), np.arange(200), np.full(200, covertree.NONE), 5)
    best.search(covertree.cover_tree(x), np.arange(2000), np.arange(2000))
    assert sum(seen) < 0.5 * 200 * 2000  # and yet nothing is lost:
    got = {(int(a), int(b)) for a, b in zip(best.ids.repeat(5), best.found_row.ravel())}
    assert got == {(i, int(j)) for i in range(200) for j in [j for j in np.lexsort((np.arange(2000), -(x @ x[i]))) if j != i][:5]}


@pytest.mark.parametrize("kw", [{}, {"first": 1}, {"pass_numbers": 200}])
def test_top_k(spark, monkeypatch, kw):
    monkeypatch.setattr(covertree, "BLOCK", 64)
    rows = [*enumerate(clustered(900, 4, 3)), *((1000 + k, [7, 7, 7, 7]) for k in range(300))]
    rows += [(None, [9, 9, 9, 9]), (100, [5, 5, 5, 5]), (100, [5, 5, 5, 5]), (200, None), (300, [1, None, 2, 3]), (400, [1, 2]), (500, [3, 4]), (700, []), (800, []), (-100, [1, 1, 1, 1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, x array<long>, score string, query_row int").repartition(3)
    got = covertree.top_k(df, F.col("vec_id") % 100 == 0, 7, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == nearest(rows, lambda i: i % 100 == 0, 7)


def test_top_k_of_large_numbers_and_of_nothing(spark):
    big = [(k, [2**26 + k, -(2**24) * k, 3]) for k in range(40)]
    df = spark.createDataFrame(big, "vec_id long, x array<long>")
    assert Counter(tuple(r) for r in covertree.top_k(df, F.col("vec_id") % 10 == 0, 3).collect()) == nearest(big, lambda i: i % 10 == 0, 3)
    with pytest.raises(Exception, match="63 bits"):
        covertree.top_k(spark.createDataFrame([(0, [2**40]), (1, [2**40])], df.schema), F.lit(True)).collect()
    assert covertree.top_k(df.limit(0), F.lit(True)).count() == 0 and covertree.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_whitening(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) * 50).astype(np.int64) + 10**9
    rows = [(k % 50 if k % 7 else None, v) for k, v in enumerate(x.tolist())] + [(1, None), (2, [1, None, 3, 4, 5, 6]), (3, [])]
    df = spark.createDataFrame([(i, v, "clash", 0.5) for i, v in rows], "vec_id long, x array<long>, whitened string, place double").repartition(4)
    out, learned = whitening.whiten(df, components=4)
    got = out.collect()
    assert len(got) == 500 and learned.n == 500 and learned.sums == x.sum(axis=0).tolist()
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(learned.values, values[::-1], rtol=1e-9) and np.isclose(learned.trace, values.sum())
    signs = np.sign((learned.vectors * vectors[:, ::-1]).sum(axis=0))
    want = {tuple(v): w for v, w in zip(x.tolist(), (x - x.mean(axis=0)) @ vectors[:, ::-1] * signs / np.sqrt(values[::-1]))}
    for r in got:
        assert np.allclose(r.whitened, want[tuple(r.x)][:4], atol=1e-7)
        assert int(r.deviation) == sum((500 * a - s) ** 2 for a, s in zip(r.x, learned.sums))
    assert whitening.identity_error(out, learned, 4) < 1e-9
    assert Counter(r.vec_id for r in got) == Counter(i for i, v in rows[:500])


def test_whitening_edges(spark):
    schema = "vec_id long, x array<long>"
    out, learned = whitening.whiten(spark.createDataFrame([], schema))
    assert out.count() == 0 and out.columns == ["vec_id", "x", "deviation", "whitened"] and whitening.identity_error(out, learned, 8) is None
    out, learned = whitening.whiten(spark.createDataFrame([(1, [3, 4]), (1, [3, 4])], schema))
    assert [r.whitened for r in out.collect()] == [[None, None]] * 2 and {int(r.deviation) for r in out.collect()} == {0}
    out, learned = whitening.whiten(spark.createDataFrame([(1, [3, 4]), (2, [5, 4])], schema), components=8)
    assert sorted(round(r.whitened[0], 9) for r in out.collect()) == [-1.0, 1.0] and {r.whitened[1] for r in out.collect()} == {None}
    assert whitening.identity_error(out, learned, 8) < 1e-12
    with pytest.raises(ValueError, match="1 to 2 dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [3, 4]), (2, [5])], schema))


def test_scatter_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST", 1)
    monkeypatch.setattr(whitening, "BLOCKS", 25)
    x = np.random.default_rng(1).integers(-99, 99, (100, 3))
    out, learned = whitening.whiten(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, x array<long>").repartition(5))
    assert np.allclose(learned.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]) and whitening.identity_error(out, learned, 3) < 1e-9


def test_query_whitening(spark, small):
    got = q.op12_whiten_embeddings(spark, small).collect()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows])) + 100_000
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    w = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert len(got) == 8 * len(rows)
    at = {r.vec_id: k for k, r in enumerate(rows)}
    for r in got:
        assert abs(abs(r.whitened) - abs(w[at[r.vec_id], r.component - 1])) < 1e-8 and abs(r.explained - values[::-1][r.component - 1] / values.sum()) < 1e-9
        assert r.n == len(rows) and r.identity_error < 1e-9
    some = next(r for r in got if r.vec_id == rows[7].vec_id)
    xs = x.astype(int)
    assert some.deviation == sum((len(rows) * int(a) - int(s)) ** 2 for a, s in zip(xs[7], xs.sum(axis=0)))


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(texts, misspell=31):
    n = Counter()
    for key, text in texts:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants_of(n):
    form, near = {}, {}
    by = {}
    for w in n:
        for i in range(len(w) + 1):
            for key in {(w[:i], w[i:], 0), *([(w[:i], w[i + 1 :], 1)] if i < len(w) else [])}:
                by.setdefault(key[0] + "\0" + key[1], set()).add(w)
    for w in n:
        close = {o for i in range(len(w) + 1) for key in (w[:i] + "\0" + w[i:], w[:i] + "\0" + w[i + 1 :]) for o in by.get(key, ()) if one_edit(w, o)}
        near[w] = len(close)
        best = min(close, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_spelling_variants(spark, folder):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = variants_of(words_of(texts))
    assert {tuple(r) for r in q.op13_spelling_variants(spark, folder).collect()} == want
    assert sum(w[1] is not None for w in want) > 5


def test_words_of_odd_texts(spark):
    texts = [(1, None), (None, "Grüße×÷ abcdefgh ABCDEFGH abcdefgÿ"), (2, ""), (3, "x" * 300_000 + " " + "x" * 300_000), (4, "abcdefg1abcdefg_abcdef İstanbulabc"), (5, ("lettersonly " * 200_000)), (6, "abcdefghĀabcdefgh")]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in texts], "doc_id long, text string, word int, id string")
    got = {r.word: r.n for r in spelling.corpus_words(df, misspell=31).collect()}
    assert got == words_of(texts) and max(map(len, got)) >= 299_999
    assert spelling.corpus_words(df.limit(0)).count() == 0
    assert spelling.variant_groups(spelling.corpus_words(df, misspell=31)).count() == len(got)


@pytest.mark.parametrize("dense", [1, 20, 10**9])
def test_one_edit_pairs_whatever_words_share(spark, dense):
    rng = random.Random(4)
    words = {"a" * k for k in range(7, 12)} | {"commonprefix" + "".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(150)} | {"".join(rng.choices("ab", k=rng.randint(1, 4))) + "commonsuffix" for _ in range(60)}
    words |= {"".join(rng.choices("ab", k=rng.randint(7, 8))) for _ in range(200)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    scratch = Scratch(spark)
    got = [(r.word, r.other) for r in spelling.near_words(df, scratch, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_forms_lead_to_roots(spark):
    words = [("aaaaaaaa", 100_000), ("aaaaaaab", 9000), ("aaaaaabb", 900), ("aaaaabbb", 80), ("aaaabbbb", 7), ("zzzzzzzz", 50), ("zzzzzzzy", 50), ("zzzzzzzx", 5), ("alone123", 2), (None, 7), ("aaaaaaaa", 1)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert len(got) == 9 and {got["a" * (8 - k) + "b" * k][1] for k in range(5)} == {"aaaaaaaa"}
    assert got["aaaaaaaa"] == (None, "aaaaaaaa", 100_001, 1, None) and got["aaaabbbb"] == ("aaaaabbb", "aaaaaaaa", 7, 1, 80)
    assert got["zzzzzzzx"] == ("zzzzzzzy", "zzzzzzzy", 5, 2, 50) and got["zzzzzzzy"][0] is None and got["alone123"] == (None, "alone123", 2, 0, None)
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
