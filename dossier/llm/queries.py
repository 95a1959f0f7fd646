"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import lm, secrets
from dossier.llm.covertree import top_k
from dossier.llm.decontam import find_leaks
from dossier.llm.langid import identify_languages, remainder, train
from dossier.llm.mixing import mix_sources
from dossier.llm.neardup import near_duplicates
from dossier.llm.pii import BASE_KINDS, find_personal_data
from dossier.llm.quality import apply_policy, rule_ledger
from dossier.llm.spelling import corpus_words, variant_groups
from dossier.llm.urls import filter_urls
from dossier.llm.warc import capture_histories
from dossier.llm.whitening import finite, identity_error, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(spans, kinds=None) -> F.Column:
    """``kind:start:end`` of the spans (of these kinds), comma-joined in their order."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents")), "v1")
    base = apply_policy(ledger, "base", "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count_of(k) for k in BASE_KINDS), F.sha2(digest(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the fixed columns: ``live`` (the live spans) and ``ownership`` (owners:repositories of each span), in the order of ``spans``."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    owned = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["owners"], s["repositories"])), ",")
    return found.select("doc_id", *(count_of(k) for k in secrets.BASE_KINDS), F.sha2(digest(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), digest(F.col("live")).alias("live"), owned.alias("ownership"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("fold", remainder("doc_id", 4))
    found = identify_languages(docs, train(docs.where("fold <> 2")))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the fixed columns: urlkey, ts and ``place`` in the order of all captures. Pages have no time of their own: theirs is made of the id."""
    second = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(1 << 31))
    part = lambda of, size: F.lpad((F.floor(second / of) % size).cast("string"), 2, "0")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.floor(second / 86_400).cast("int")).cast("string")
    found = capture_histories(table(spark, sf_dir, "pages"), ts=F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "place")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(remainder("doc_id", 5) != 1))
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return lm.score_texts(docs, model).select("doc_id", held, "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _whole(rows: DataFrame, plus: int) -> DataFrame:
    """vec_id and x: floor(1024 * c) + ``plus`` of each component, of vectors without null or non-finite ones."""
    return rows.where(finite(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + plus).alias("x"))


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_whole(table(spark, sf_dir, "embeddings"), 0), F.col("vec_id") % 100 == 0, 10).select("query_id", "rank", "vec_id", "score")


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, learned = whiten(_whole(table(spark, sf_dir, "embeddings"), 100_000), components=8)
    error = F.lit(identity_error(rows, learned, 8)).cast("double")
    shares = F.array(*(F.lit(float(v / learned.trace) if learned.trace else None).cast("double") for v in learned.values[:8])) if learned.n else F.array().cast("array<double>")
    each = rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(learned.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), error.alias("identity_error"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(corpus_words(table(spark, sf_dir, "documents"), misspell=31)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_quality_ledger, op3_url_filter, op4_personal_data, op5_near_duplicates, op6_secret_scan, op7_language_id, op8_warc_index, op9_lm_score, op10_decontaminate, op11_top_k_search, op12_whiten_embeddings, op13_spelling_variants)}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT skey, min(source) AS source, CAST(sum(size) AS DOUBLE) AS ss FROM d GROUP BY skey),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS pos FROM s),
w AS (SELECT *, CAST([3, 1, 2][(pos - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * ss AS cap FROM p),
r AS (
  SELECT *, cap / weight AS ratio, sum(ss) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS aw,
         coalesce(sum(cap) OVER b, 0) AS cc, coalesce(sum(weight) OVER b, 0) AS cw, row_number() OVER (ORDER BY cap / weight, pos) AS rk
  FROM w WINDOW b AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - cc) / (aw - cw), rk) AS level FROM r WHERE (total - cc) / (aw - cw) <= ratio),
t AS (SELECT skey, ss, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM r, l),
f AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS n FROM t),
g AS (SELECT *, target - ss * n AS budget FROM f),
c AS (SELECT skey, h >> 30 AS cell, CAST(sum(size) AS DOUBLE) AS x FROM d GROUP BY ALL),
u AS (SELECT skey, cell, x, sum(x) OVER (PARTITION BY skey ORDER BY cell) AS upto FROM c),
e AS (SELECT g.skey, CASE WHEN x < 2 * (budget - (upto - x)) THEN cell + 1 ELSE cell END AS cut FROM u JOIN g ON u.skey = g.skey WHERE upto > budget AND upto - x <= budget)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
       CAST(size * least(2, n + CASE WHEN (h >> 30) < coalesce(cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.skey = g.skey LEFT JOIN e ON d.skey = e.skey
"""

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
li AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
x AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i + 7]) AS k FROM x),
z AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM y WHERE k > 1) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN lc ON d.rid = lc.rid LEFT JOIN z ON d.rid = z.rid),
f AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_letters >= 20 AND 100 * n_upper > 60 * n_letters THEN 8 ELSE 0 END)
         + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') AS url, ((coalesce(page_id, 0) % 2147483648) + 2147483648) % 2147483648 AS s FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keeper,
        array_to_string(list_reverse(string_split(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS urlkey,
        strftime(TIMESTAMP '2000-01-01' + to_seconds(s), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id < keeper AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to,
       urlkey, ts, row_number() OVER (ORDER BY encode(urlkey), ts, page_id NULLS FIRST) - 1 AS place FROM r
"""

_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.x, d.x)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.x) = len(d.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op11_top_k_search": _OP11, "op8_warc_index": _OP8, "op1_mix_sources": _OP1, "op2_quality_ledger": _OP2}
