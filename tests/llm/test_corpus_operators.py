"""Operators over the whole corpus, against brute force, on hand-made rows and on the small tables."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import decontam, lm, mixing, neardup, urls, warc
from dossier.llm import queries as q
from dossier.llm.components import connected_components
from dossier.llm.eliasfano import EliasFano, encode

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, kept boolean"


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def made(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 3, 4, False) for d, t, s in rows], SCHEMA)


# --- mixing

def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "a", "a", "b", "é", None, "Z"])) for k in range(4000)] + [(None, "x y", "a"), (7, None, "b"), (7, "same id", "b")]
    got = mixing.mix_sources(made(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes)
    again = mixing.mix_sources(made(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_of_one_very_long_text(spark):
    rows = [(0, "w " * 300_000, "a")] + [(k, "w " * 10, "a") for k in range(1, 300)] + [(1000 + k, "w " * 10, "b") for k in range(300)]
    got = mixing.mix_sources(made(spark, rows)).collect()
    sizes = {"a": 302_990, "b": 3000}
    want = plain_targets(sizes)
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= 300_000 and taken <= 2 * sizes[s]
    assert {r.taken for r in got if r.doc_id == 0} <= {0, 300_000, 600_000}


def test_mixing_edges(spark):
    assert mixing.mix_sources(made(spark, []).limit(0)).count() == 0
    empty = mixing.mix_sources(made(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


# --- urls

def test_url_rules(spark):
    cases = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"), "http://net": ("net", "", None, None), "https://m.example.net/en/1?a=/b#c": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://badexample.com/de/": ("badexample.com", "/de/", None, None), "x://org/fr/#": ("org", "/fr/", "org/fr/", "allow"),
        None: ("", "", None, None), "nothing": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "h://É.NET?x": ("É.net", "", None, None), "a\nb://h\n/p\nq": ("h\n", "/p\nq", None, None),
    }
    pages = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(cases)], "page_id long, url string, host string, score double")
    got = {r.url: r for r in urls.filter_urls(pages).collect()}
    for url, (host, path, rule, verdict) in cases.items():
        r = got[url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict), url
    assert urls.filter_urls(pages.limit(0)).count() == 0


def plain_rule(url):
    """Host, path and rule of a url, by plain string work."""
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate(ASCII_LOWER), rest[end:]
        path = re.split("[?#]", rest)[0]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_rules_of_whole_table(spark):
    got = q.op3_url_filter(spark, "/root/testdata/sf0.1").collect()
    raw = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()}
    assert len(got) == len(raw)
    for r in got:
        host, path, rule, verdict = plain_rule(raw[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if rule else r.verdict in ("allow", "block"))
    # A rule for one path of a host does not spread over the host's other pages.
    open_ = [r for r in got if r.rule is None and r.host.endswith("example.com")]
    assert open_ and sum(r.verdict == "block" for r in open_) < len(open_)


def test_url_trees_of_rules_must_hold_on_other_suffixes(spark):
    """Rules block long urls full of digits on some hosts: that carries over. Rules that follow no feature do not."""
    digits = [(k, f"http://h.{d}.biz/{k * 7919}/{k * 104729}?a={k}&b={k * 31}&c=1") for k, d in enumerate([f"d{k % 12}" for k in range(600)])]
    plain = [(1000 + k, f"http://h.{d}.biz/about") for k, d in enumerate([f"e{k % 12}" for k in range(600)])]
    rules = [(f"d{k}.biz", "/", "block") for k in range(0, 12, 2)] + [(f"e{k}.biz", "/", "allow") for k in range(0, 12, 2)]
    pages = spark.createDataFrame(digits + plain, "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages, rules=rules).collect()}
    assert all(got[k].verdict == ("block" if k < 1000 else "allow") for k in got) and any(r.rule is None for r in got.values())
    mixed = [(f"{c}{k}.biz", "/", "block" if k % 4 else "allow") for c in "de" for k in range(0, 12, 2)]
    assert {r.verdict for r in urls.filter_urls(pages, rules=mixed).where("rule IS NULL").collect()} == {"allow"}


def test_url_odd_rows(spark):
    long = "http://a.b.example.net/" + "x/1-" * 100_000 + "?" + "k=v&" * 20_000
    rows = [(1, long), (2, long), (None, "http://example.com/de/a"), (3, "http://example.com/de/a"), (3, "http://example.com/de/a"), (4, None), (5, "")]
    got = urls.filter_urls(spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows], "page_id long, url string, suffix string, score double, fold string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.url == long} == {"block"} and {(r.rule, r.verdict) for r in got if r.url == "http://example.com/de/a"} == {("example.com/de/", "block")}
    assert {r.verdict for r in got if not r.url} == {"allow"}


def test_url_trees_learn(spark):
    bad = [(f"http://x{k}.spam-{k % 7}.biz/{k * 7919}/{k * 104729}?a={k}&b={k * 31}&c=1",) for k in range(300)]
    good = [(f"http://site{k % 9}.example.org/about",) for k in range(300)]
    labelled = spark.createDataFrame([(u, "block") for (u,) in bad[::2]] + [(u, "allow") for (u,) in good[::2]], "url string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, (u,) in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, rules=(), labelled=labelled).collect()}
    assert sum(got[k] == ("block" if k < 300 else "allow") for k in got) >= 590
    only = urls.filter_urls(pages, rules=(), labelled=labelled.where("verdict = 'block'")).groupBy("verdict").count().collect()
    assert [r.verdict for r in only] == ["block"]


# --- near duplicates

def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in where[x])
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for x in s:
            where[x].append(k)
    low = {}
    for k, (d, _, _) in enumerate(rows):
        if d is not None and sets[k]:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _, _) in enumerate(rows)]


def near_rows(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = [(None, None, "s"), (1, "", "s"), (2, " \n", "s"), (3, "A b", "s"), (4, "a B", "s"), (5, "a b c d e", "s"), (5, "a b c d e f", "s")]
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(4, 200))]
        for _ in range(draw.randint(1, 25)):
            text = [draw.choice(vocabulary) if draw.random() < draw.choice([0, 0.01, 0.03]) else x for x in base]
            rows.append((len(rows) + 10, " ".join(text) + (" " + passage if draw.random() < 0.4 else ""), "s"))
    rows += [(900 + k, " ".join(draw.choice(vocabulary) for _ in range(30)) + " " + passage, "s") for k in range(150)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "compared"), [(1, neardup.COMPARED), (2, neardup.COMPARED), (3, 4)])
def test_near_duplicates(spark, monkeypatch, seed, compared):
    monkeypatch.setattr(neardup, "COMPARED", compared)
    rows = near_rows(seed)
    got = neardup.near_duplicates(made(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(plain_components(rows), key=str)
    assert all(r.kept == ((r.doc_id == r.component_id) if r.component_id is not None and r.doc_id is not None else r.component_id is None) for r in got)


def test_near_duplicates_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMPARED", 16)
    draw = random.Random(5)
    template = [f"t{k}" for k in range(154)]
    pages = [template + [f"w{draw.randrange(40_000)}" for _ in range(50)] for _ in range(300)]
    near = [p[:-k] for p in pages[:40] for k in (3, 9)] + [p[:154] + p[160:] for p in pages[20:60]]
    # Pages alike through their own words, and pages so little apart that the template alone nearly links them.
    short = [template + [f"v{draw.randrange(40_000)}" for _ in range(n)] for n in range(18, 34) for _ in range(6)]
    texts = [" ".join(x) for x in pages + near + short]
    draw.shuffle(texts)
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = neardup.near_duplicates(made(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(made(spark, []).limit(0)).count() == 0
    got = neardup.near_duplicates(made(spark, [(None, "a b c", "s"), (8, "A b c", "s"), (None, "alone here", "s"), (9, "x " * 200_000, "s")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("8", 1, "8", True), ("9", 1, "9", True), ("None", 1, "8", False), ("None", 1, "None", True)]


def test_estimate_follows_similarity():
    a, b = neardup._families()
    draw = np.random.default_rng(0)
    for overlap in (0.3, 0.6, 0.9):
        mine = draw.integers(0, 2**64, 4000, dtype=np.uint64)
        other = np.concatenate([mine[: int(4000 * overlap)], draw.integers(0, 2**64, 4000 - int(4000 * overlap), dtype=np.uint64)])
        x, y = (neardup._packed(neardup._minima(v, a, b)[None, :])[0] for v in (mine, other))
        xor = x ^ y
        different = int(np.bitwise_count((xor | xor >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
        estimate = ((1 - different / 128) - 0.25) / 0.75
        assert abs(estimate - overlap / (2 - overlap)) < 0.2


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (5, 5)] + [(200, 201 + k) for k in range(300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {0} and got[101] == got[103] == 100 and all(got[201 + k] == 200 for k in range(300))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- archives

def test_archives(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [(1, "http://b.example.com/x", big), (2, "http://a.example.com/x?q", big), (3, None, big), (4, "http://a.example.com/x", None), (5, "u\r\nv", "small"), (6, "http://a.example.com/x", "small"), (None, "http://n/", big), (3, None, big)]
    pages = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, record_type string, n int")
    path = f"file://{tmp_path}/warc"
    got = warc.capture_histories(pages.repartition(3), path=path).orderBy("place").collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert [(r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for k in (1, 2) for r in by[k]] == [("revisit", 3, len(big.encode()), digest)] * 2
    assert [r.record_type for r in by[3]] == ["response"] * 2 and by[None][0].record_type == "response" and by[4][0].payload_bytes == 0
    keys = [warc.capture_order(tuple(r[3:])) for r in got]
    assert keys == sorted(keys)
    assert [r.place for r in got] == list(range(len(rows)))
    for r in got:  # each record alone, by its offset; and the archive as a whole
        head, block = warc.read_record(path, r.archive, r.offset, r.record_length)
        assert (head["WARC-Type"], head["X-Url-Key"], head["WARC-Date"]) == (r.record_type, r.urlkey, r.ts) and len(block) == (0 if r.record_type == "revisit" else r.payload_bytes)
        with open(f"{tmp_path}/warc/{r.archive}", "rb") as f:
            assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    archives = warc.write_archives(pages.repartition(3), path, archive_rows=2)
    assert archives.count() >= 4 and archives.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.write_archives(pages.repartition(3), path, archive_bytes=1).count() == len(rows)
    parts = warc.merge_index(warc.read_index(archives, path), range_rows=2).orderBy("part", "position").collect()
    assert [(r.urlkey, r.ts, r.page_id, r.record_type) for r in parts] == [(r.urlkey, r.ts, r.page_id, r.record_type) for r in got]
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    large = "é" * 3_000_000
    rows = [(2**62, "http://a/", large), (-(2**62), "http://a/", large), (10**12, "http://b.é/x y", None), (0, "http://a/", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in q.op8_warc_index(spark, str(tmp_path)).collect()}
    assert got[-(2**62)].refers_to == 2**62 and got[2**62].payload_bytes == 6_000_000 and got[10**12].payload_bytes == 0
    assert sorted(r.place for r in got.values()) == [0, 1, 2, 3] and all(len(r.ts) == 20 for r in got.values())


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9])
def test_loser_tree(k):
    draw = random.Random(k)
    runs = [sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 40))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


# --- language model

@pytest.mark.parametrize(("top", "n"), [(2**64 - 1, 5000), (2**34, 3000), (50, 30), (10**6, 400_000), (2**40, 1), (1, 1), (9, 0)])
def test_elias_fano(top, n):
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, top, n, dtype=np.uint64))
    coded = EliasFano(encode(values))
    assert (coded.find(values) == np.arange(len(values))).all()
    asked = np.unique(draw.integers(0, top, 20_000, dtype=np.uint64))
    found, there = coded.find(asked), np.isin(asked, values)
    assert ((found >= 0) == there).all() and (values[found[there]] == asked[there]).all()
    if top < 2**63:
        assert (coded.get(np.arange(len(values))) == values.astype(np.int64)).all()
        twice = np.sort(np.concatenate([values, values[::3]]))
        assert (EliasFano(encode(twice)).get(np.arange(len(twice))) == twice.astype(np.int64)).all()


def plain_scores(texts, train, least):
    tokens = [words(t) + [None] for t in texts]
    count = [collections.Counter() for _ in range(3)]
    for k in train:
        for n in (1, 2, 3):
            for i in range(len(tokens[k]) - n + 1):
                count[n - 1][tuple(tokens[k][i : i + n])] += 1
    total, left = [None, collections.Counter(), collections.Counter()], [None, {}, {}]
    for n in (1, 2):
        for g, c in count[n].items():
            total[n][g[:-1]] += c
        for g, c in count[n].items():
            if c >= least:
                left[n][g[:-1]] = left[n].get(g[:-1], 1) - (c - 0.75) / total[n][g[:-1]]
    size, types = sum(count[0].values()), len(count[0])
    out = []
    for t in tokens:
        base = score = known = 0
        for i in range(len(t)):
            c = count[0][(t[i],)]
            known += c > 0
            p = (c + 0.5) / (size + 0.5 * (types + 1))
            base += math.log10(p)
            for n in (1, 2):
                if i >= n:
                    g = tuple(t[i - n : i + 1])
                    p = ((count[n][g] - 0.75) / total[n][g[:-1]] if count[n][g] >= least else 0) + left[n].get(g[:-1], 1) * p
            score += math.log10(p)
        out.append((len(t), known, base, score))
    return out, size


@pytest.mark.parametrize("least", [1, 2])
def test_language_model(spark, small, least):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1]
    ids = sorted(texts)
    want, size = plain_scores([texts[k] for k in ids], [ids.index(k) for k in train], least)
    if least == 1:
        got = {r.doc_id: r for r in q.op9_lm_score(spark, small).collect()}
        assert all(r.train_tokens == size and r.held_out == (k not in train) for k, r in got.items())
    else:
        got = {r.doc_id: r for r in lm.score_texts(docs, lm.train(docs.where(F.col("doc_id").isin(train)), min_count=least)).collect()}
    for k, (n, known, base, score) in zip(ids, want, strict=True):
        r = got[k]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.06 * n
    held = [r for r in got.values() if r.doc_id not in train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_keeps_what_occurs_once(spark):
    docs = made(spark, [(1, "the quick brown fox jumps", "s")])
    # Every n-gram occurs once: 2 of the 6 tokens' levels fall short at the start, the others have a share of 1 - 0.75.
    r = lm.score_texts(docs, lm.train(docs)).first()
    base, want = 1.5 / (6 + 0.5 * 7), 0
    for i in range(6):
        p = base
        for n in (1, 2):
            p = 0.25 + 0.75 * p if i >= n else p
        want += math.log10(p)
    assert r.base_score == pytest.approx(6 * math.log10(base)) and abs(r.score - want) <= 0.06 * 6


def test_language_model_in_many_files(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: r.score for r in lm.score_texts(docs, lm.train(docs)).collect()}
    for name, value in (("SHARD_BYTES", 20_000), ("WORD_SHARD_BYTES", 50_000), ("GATHER", 10_000), ("OPEN_FILES", 3)):
        monkeypatch.setattr(lm, name, value)
    model = lm.train(docs)
    assert model["spread"] > 1 and len(model["bases"]) > 4
    assert {r.doc_id: r.score for r in lm.score_texts(docs, model).collect()} == pytest.approx(want, abs=0.01, rel=1e-3)


def test_language_model_edges(spark):
    docs = made(spark, [(None, None, "s"), (1, "", "s"), (1, "a a a a a b", "s"), (2, "ж " * 100_000, "s")])
    model = lm.train(docs)
    got = lm.score_texts(docs, model).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 7, 100_001] and model["tokens"] == 100_010
    nothing = lm.train(docs.limit(0))
    assert nothing["tokens"] == 0 and {r.score for r in lm.score_texts(docs, nothing).collect()} == {0.0}
    assert lm.score_texts(docs.limit(0), model).count() == 0


# --- decontamination

def test_common_subsequence():
    draw = random.Random(4)
    for _ in range(300):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(0 for _ in b)] if not row else row
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontam.common_subsequence(a, b) == row[-1]


def test_leaks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    clean = [r.text for r in docs.where("lang = 'en' AND n_chars > 1500").orderBy("doc_id").limit(30).collect()]
    items = {r.item_id: r.text for r in bench.collect()}
    put = {}
    for k, (item, t) in enumerate(list(items.items())[:20]):
        w, body = t.split(), clean[k].split()
        spot = 17 * k % len(body)
        if k % 2:  # a paraphrase: one word in six changed, the last sentence kept
            last = max((i for i in range(len(w) - 1) if w[i][-1] in ".!?"), default=-1) + 1
            w = [x if i % 6 or i >= last else "paraphrased" for i, x in enumerate(w)]
        put[1000 + k] = (item, " ".join(body[:spot] + w + body[spot:]))
    rows = [(k, t, "s") for k, (_, t) in put.items()] + [(2000 + k, t, "s") for k, t in enumerate(clean)] + [(None, None, "s"), (3000, "", "s")]
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(made(spark, rows), bench).collect()}
    own = {(r.doc_id + 1000, r.item_id) for r in decontam.find_leaks(made(spark, rows), bench).where("doc_id >= 2000").collect()}
    assert {(k, item) for k, (item, _) in put.items()} <= got and len(own) <= 2
    kept = decontam.drop_leaking(made(spark, rows), bench)
    assert kept.columns == made(spark, rows).columns and {r.doc_id for r in kept.collect()} == {d for d, _, _ in rows} - {d for d, _ in got}
    assert decontam.find_leaks(made(spark, rows), bench.limit(0)).count() == 0 == decontam.find_leaks(made(spark, []).limit(0), bench).count()
    assert decontam.drop_leaking(made(spark, rows), bench.limit(0)).count() == len(rows)


def paraphrased(draw, text, share, other):
    """The text with this share of its words exchanged by ``other(word)``, those of its last sentence left as they are."""
    w = text.split()
    last = max((i for i in range(len(w) - 1) if w[i][-1] in ".!?"), default=-1) + 1
    last = last if 0 < last <= len(w) - 3 else len(w) - 5
    some = draw.sample(range(last), min(last, round(share * len(w))))
    return " ".join(other(x) if i in some else x for i, x in enumerate(w))


@pytest.mark.parametrize(("share", "endings", "recall"), [(0.3, False, 0.9), (0.38, False, 0.9), (0.45, False, 0.9), (0.52, False, 0.85), (0.5, True, 0.9)])
def test_paraphrases_are_found_in_the_latent_space(spark, share, endings, recall):
    draw = random.Random(f"{share}{endings}")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").where(F.regexp_count("text", F.lit(" ")) > 30)
    eights = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    taken = {x for r in bench.collect() for x in eights(r.text)}
    clean = [r for r in docs.where("lang = 'en' AND n_chars > 1500").orderBy("doc_id").limit(150).collect() if not eights(r.text) & taken]
    vocabulary = sorted({x for r in clean for x in r.text.split()})
    rows, put = [(5000 + k, r.text, "s") for k, r in enumerate(clean)], set()
    for k, (item, t) in enumerate(sorted((r.item_id, r.text) for r in bench.collect())):
        w, body = paraphrased(draw, t, share, lambda x: x.rstrip(".,") + "ings" if endings else draw.choice(vocabulary)).split(), clean[k % len(clean)].text.split()
        spot = draw.randrange(len(body))
        rows.append((k, " ".join(body[:spot] + w + body[spot:]), "s"))
        put.add((k, item))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(made(spark, rows), bench).collect()}
    assert len(put) > 80 and len(got & put) >= recall * len(put)
    assert len(clean) > 100 and not {d for d, _ in got if d >= 5000}
    if share == 0.38:  # without the latent space they are lost
        blind = {(r.doc_id, r.item_id) for r in decontam.find_leaks(made(spark, rows), bench, min_cosine=2.0).collect()}
        assert len(blind & put) < 0.5 * len(put)


def test_leaks_of_whole_table(spark):
    got = {(r.doc_id, r.item_id) for r in q.op10_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    where = collections.defaultdict(set)
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 7):
            where[tuple(w[i : i + 8])].add((r.item_id, len(w) - 7))
    for d, w in docs.items():
        hits = collections.Counter(x for i in range(len(w) - 7) for x in where.get(tuple(w[i : i + 8]), ()))
        for (item, n), h in hits.items():
            assert h < 0.9 * n or (d, item) in got
    assert len({d for d, _ in got}) < 0.1 * len(docs)


def zipf_words(draw, n, vocabulary=20_000):
    return [f"w{int(vocabulary ** draw.random())}" for _ in range(n)]


def test_leaks_of_many_passages(spark):
    draw = random.Random(8)
    items = [(k, " ".join(zipf_words(draw, 38))) for k in range(5000)]
    docs, put = [], set()
    for k in range(300):
        body, item = zipf_words(draw, 300), 16 * k
        docs.append((k, " ".join(body[:101] + items[item][1].split() + body[101:]), "s"))
        put.add((k, item))
    got = decontam.find_leaks(made(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.common == 38 and r.verdict == "copy"} == put


@pytest.mark.parametrize(("passages", "size"), [(4000, 30), (1000, 12), (1000, 6), (200, 4)])
def test_no_copied_passage_is_lost(spark, passages, size, monkeypatch):
    draw = random.Random(size)
    items = [(k, " ".join(zipf_words(draw, size))) for k in range(passages)]
    docs, put = [], set()
    for k in range(150):
        body, item = zipf_words(draw, 300), k * (passages // 150)
        docs.append((k, " ".join(body[:77] + items[item][1].split() + body[77:]), "s"))
        put.add((k, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(made(spark, docs), bench).collect()}
    assert put <= got
    if passages == 200:  # in several passes over the documents the same
        monkeypatch.setattr(decontam, "PASSAGES_A_PASS", 64)
        assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(made(spark, docs), bench).collect()} == got


def test_leaks_in_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(1, text, "s"), (1, text, "s"), (None, text.upper(), "s"), (2, "y " * 400_000 + text + " z" * 1000, "s"), (3, None, "s"), (4, "word1 word0", "s")]
    bench = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (10, "...")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.find_leaks(made(spark, rows), bench).collect())
    assert got == sorted([("1", 7)] * 4 + [("None", 7)] * 2 + [("2", 7)] * 2)
    assert sorted(str(r.doc_id) for r in decontam.drop_leaking(made(spark, rows), bench).collect()) == ["3", "4"]


def test_leaks_of_short_passages_amid_rare_words(spark):
    draw = random.Random(9)
    items = [(k, " ".join(zipf_words(draw, 1 + k % 20, 300))) for k in range(200)]
    docs = [(k, " ".join([f"r{k}x{i}" for i in range(150)] + t.split() + [f"r{k}y{i}" for i in range(150)]), "s") for k, t in items]
    docs += [(1000 + k, " ".join(zipf_words(draw, 60, 300)), "s") for k in range(400)]
    got = {(r.doc_id, r.item_id): r.common for r in decontam.find_leaks(made(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got.get((k, k)) == 1 + k % 20 for k, _ in items)
    for d, t, _ in docs:
        w = words(t)
        for k, p in items:
            p = words(p)
            if len(p) < 8:
                assert ((d, k) in got) == any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)), (d, k)


# --- the pipeline

def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(after) <= before and len(after) == len(set(after)), name
    assert docs.count() >= 0.7 * start
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert all(c == d for d, _, c in plain_components(rows))
    mix = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in mix.collect()} <= set(after) and mix.agg(F.sum("taken")).first()[0] > 0


def test_near_duplicate_stage_decides_by_row(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white")
    rows = [(None, one), (3, one), (None, "unique without an id"), (7, one), (7, "unique under an id that repeats"), (None, two), (None, two), (5, three), (5, three), (None, None), (None, ""), (5, "")]
    left = corpus_pipeline.near_duplicate_stage(spark, made(spark, [(d, t, "s") for d, t in rows]), "")
    want = [(3, one), (None, "unique without an id"), (7, "unique under an id that repeats"), (None, two), (5, three), (None, None), (None, ""), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    named = made(spark, [(1, one, "s"), (2, two, "s"), (3, one, "s")]).withColumn("__row", F.lit("mine"))
    left = corpus_pipeline.near_duplicate_stage(spark, named, "")
    assert left.columns == named.columns and sorted((r.doc_id, r["__row"]) for r in left.collect()) == [(1, "mine"), (2, "mine")]


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some plain words of text here", "en", None, 29), (2, "some plain words of text here", "en", "a", 29), (3, "x " * 50_000, None, "a", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= 5 and (k == 4 or out.columns == docs.columns), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
