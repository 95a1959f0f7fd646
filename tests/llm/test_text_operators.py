"""Operators on single texts, against plain Python, on hand-made rows and on the small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import langid, pii, quality, secrets
from dossier.llm import queries as q

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, kept boolean"


def rows(texts):
    return [(k if k % 5 else None, t, "en", "src", None, 7, "x", True) for k, t in enumerate(texts)]


EDGE = [None, "", " \t\n\x0b\x0c\r", "a", "\n\n a b \n a b \n\na b", "x" * 300_000, "é ü ß 日本 🎈 " * 50, "a b c d e f g h " * 40, "one two " * 3 + " z", "#### $$$ |||"]


def measures(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures(spark, small):
    texts = EDGE + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.apply_policy(quality.rule_ledger(docs)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), k
    table = {r.rule: r for r in quality.ablations(quality.rule_ledger(docs)).collect()}
    assert table["few_words"].failed == sum(r.n_words < 20 for r in got.values())
    assert table["few_words"].kept == sum(r.kept for r in got.values())


def test_quality_of_texts_larger_than_a_piece(spark, monkeypatch):
    texts = ["some words of a line\n" * 3000, None, "x", "a b c " * 9000, "no line twice " + " ".join(map(str, range(20_000)))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(quality, "pieces", lambda batches, column, pieces=quality.pieces: pieces(batches, column, 1000))
    for r in quality.rule_ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])


def test_quality_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.apply_policy(quality.rule_ledger(docs)).join(labels, "doc_id").where("n_words >= 20")
    by = {(r.quality, r.kept): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert by[(1, True)] >= 0.97 * (by[(1, True)] + by.get((1, False), 0))
    assert by[(0, False)] >= 0.9 * (by[(0, False)] + by.get((0, True), 0))


BASE_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, pattern in BASE_PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_equals_patterns(seed):
    draw, automaton = random.Random(seed), pii.anchors()
    for _ in range(20_000):
        text = "".join(draw.choice("aé1 2.9@.-+()0 é%") for _ in range(draw.randint(0, 40)))
        assert [s for s in pii.find_spans(text, automaton) if s[0] in BASE_PII] == plain_pii(text), text
    assert pii.find_spans("IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789; account no 00123456", automaton)[-3:] == [("iban", 6, 33), ("ssn", 39, 50), ("account", 63, 71)]


@pytest.mark.parametrize(("text", "found"), [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000 I paid", "DE89370400440532013000"), ("IBAN: GB29NWBK60161331926819 USD 500", "GB29NWBK60161331926819"),
    ("to GB29NWBK60161331926819, thanks", "GB29NWBK60161331926819"), ("FR14 2004 1010 0505 0001 3M02 606 A", "FR14 2004 1010 0505 0001 3M02 606"), ("DE89 3704 0044 0532 0130 01", None), ("xDE89370400440532013000", None),
    ("DE893704004405320130001", None), ("ZZ89370400440532013000", None), ("DE8\u0664370400440532013000", None), ("DE89", None),
])
def test_account_numbers(text, found):
    spans = [s for s in pii.find_spans(text, pii.anchors()) if s[0] == "iban"]
    assert spans == ([("iban", text.index(found), text.index(found) + len(found))] if found else [])


@pytest.mark.parametrize("n", [10, 300, 1500, 100_000])
def test_login_of_any_length(n):
    text = f"see https://oauth2:{'eyJ.' * (n // 4)}@host/x and http://a:b/c@d"
    assert [s for s in pii.find_spans(text, pii.anchors()) if s[0] == "url_login"] == [("url_login", 12, text.index("@host"))]


def test_personal_data_query(spark, small):
    got = {r.doc_id: r for r in q.op4_personal_data(spark, small).collect()}
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        spans = plain_pii(text or "")
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert got[doc_id].n_email == sum(s[0] == "email" for s in spans)


BASE_SECRETS = {"assign": secrets.ASSIGN.replace("(?i:", "(?:"), "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_secrets(text):
    out = []
    for n, kind in enumerate(BASE_SECRETS):
        pattern = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" if kind == "assign" else BASE_SECRETS[kind]
        for m in re.finditer(pattern, text):
            if {"assign": len(m[m.re.groups]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_secrets_equal_patterns(spark, small):
    draw = random.Random(5)
    texts = EDGE + ["".join(draw.choice(["token", "Secret", "=", ": ", '"', "abc", "0a1b2c3d4e5f", "AKIA", "QX7", "é", " ", "🎈", "password", "api_key"]) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "token"] for r in secrets.scan_secrets(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_secrets(t or ""), t


def test_secret_ownership(spark):
    shared, own = "token = abcdef1234567890abcd", "token = zyxw9876543210zyxwvu"
    docs = spark.createDataFrame([(k, shared, f"o{k}") for k in range(5)] + [(9, own, "o1"), (10, own, None), (None, None, None)], "doc_id long, text string, source string")
    live = {r.doc_id: [secrets_value(s) for s in r.live] for r in secrets.scan_secrets(docs).collect()}
    assert live[0] == [] and live[9] == ["zyxw9876543210zyxwvu"] == live[10] and live[None] == []
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[9] == "token = [secret]" and clean[0] == shared and clean[None] is None
    assert {r.owners for r in secrets.ownership(docs).collect()} == {5, 1}


def test_secret_of_one_owner_in_many_documents(spark):
    rows = [(k, "token = zyxw9876543210zyxwvu", "o1") for k in range(150)] + [(200, "password: hunt3r2", "o2"), (201, "password: aaa111", "o2")]
    rows += [(300 + k, "passwd=sh4red77", f"o{k}") for k in range(3)]
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {clean[k] for k in range(150)} == {"token = [secret]"} and clean[200] == "password: [secret]"
    assert clean[201] == "password: aaa111" and {clean[300 + k] for k in range(3)} == {"passwd=sh4red77"}


def secrets_value(span):
    return span.value.split(" = ")[-1]


def test_languages_held_out(spark):
    found = q.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = found.join(truth, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_languages_edge_and_mixed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    en, fr = (next(r.text for r in docs.where(f"lang = '{x}' AND n_chars > 900 AND n_chars < 3000 AND text NOT LIKE '%|%' AND text NOT LIKE '%$%'").orderBy("doc_id").limit(1).collect()) for x in ("en", "fr"))
    made = spark.createDataFrame(rows([*EDGE, "123 !!! ...", "ЖЗИ йк", f"{en}\n{fr}"]), SCHEMA)
    got = langid.identify_languages(made, model).collect()
    assert len(got) == len(EDGE) + 3
    assert [got[k].lang_pred for k in (0, 1, 2, len(EDGE))] == ["und"] * 4
    assert got[len(EDGE) + 1].lang_pred in model["langs"]
    mixed = got[-1]
    assert [s.lang for s in mixed.spans] == ["en", "fr"] and abs(mixed.spans[1].start - len(en)) < 60 and mixed.spans[-1].end <= len(en) + 1 + len(fr)
    assert {r.lang_pred for r in langid.identify_languages(made, {"langs": []}).collect()} == {"und"}


def test_scripts_by_code_points():
    letters = {"a": "latin", "é": "latin", "Ệ": "latin", "λ": "greek", "ж": "cyrillic", "ש": "hebrew", "ع": "arabic", "क": "devanagari", "ท": "thai", "日": "han", "か": "kana", "한": "hangul", "𠀋": "han", "Ꭰ": "cherokee", "ꯀ": "other"}
    for c, name in letters.items():
        assert langid.SCRIPT_NAMES[langid.scripts_of(np.array([ord(c)]))[0]] == name, c
    assert (langid.scripts_of(np.array([ord(c) for c in "1 .!“”—…€×÷🎈¿«\u0301\u3000"])) == -1).all()
    text = "aλ 日“ж”!é🎈"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    want = [-1] * len(data)
    at = 0
    for c in text:
        want[at] = int(langid.scripts_of(np.array([ord(c)]))[0])
        at += len(c.encode())
    assert langid.byte_scripts(data).tolist() == want


def test_score_tells_unlearned_texts(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = ["Και τώρα η ελληνική γλώσσα", "Теперь русский язык", "ภาษาไทย", "“—…” 123", "of the and then there"]
    got = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [got[k].score for k in range(4)] == [0] * 4 and got[3].lang_pred == "und" and got[4].lang_pred == "en" and got[4].score > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_plain_one(seed):
    draw = np.random.default_rng(seed)
    size, counts = int(draw.integers(1, 300)), draw.integers(0, 12, 9)
    first, scores, prior = np.concatenate([[0], np.cumsum(counts)]), draw.standard_normal((int(counts.sum()), size)).astype(np.float32), draw.standard_normal(size).astype(np.float32)
    label, penalty = langid.viterbi(scores, first, prior, 1.0), 1.0
    for a, z in zip(first, first[1:]):  # noqa: B905
        worth = lambda path, a=a: prior[path[0]] + sum(scores[a + k, x] for k, x in enumerate(path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B905, E731
        if z > a:
            best = prior + scores[a]
            for t in range(a + 1, z):
                best = np.maximum(best, best.max() - penalty) + scores[t]
            assert worth(label[a:z].tolist()) == pytest.approx(best.max(), abs=1e-3)


def test_three_hundred_languages(spark):
    text = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}{chr(97 + k % 26)}{chr(97 + k // 26)}" for c in "qwertz")
    docs = spark.createDataFrame([(k, text(k), f"l{k:03d}") for k in range(300)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model["langs"]) == 300
    got = langid.identify_languages(docs, model).collect()
    assert [r.lang_pred for r in sorted(got)] == [f"l{k:03d}" for k in range(300)] and {r.share for r in got} == {1.0} and min(r.score for r in got) > 0.9
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.range(1001).select(F.lit("x").alias("text"), F.col("id").alias("lang")))


@pytest.mark.parametrize("run", [lambda d: quality.rule_ledger(d), pii.find_personal_data, secrets.scan_secrets, lambda d: langid.identify_languages(d, {"langs": []}), secrets.ownership])
def test_edge_rows_and_empty(spark, run):
    docs = spark.createDataFrame(rows(EDGE), SCHEMA)
    out = run(docs)
    assert "doc_id" not in out.columns or out.count() == len(EDGE)
    assert run(docs.limit(0)).count() == 0
