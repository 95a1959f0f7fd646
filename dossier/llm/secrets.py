"""Secrets by corpus-wide ownership frequency (DataFrame functions only).

Patterns give candidates with their offsets. Each candidate's hash is aggregated over the whole corpus by
distinct repositories and owners. A candidate of many owners is a widely copied example; one of few owners that
looks alive (mixed, not a placeholder) is its owner's own credential, in however many of the owner's repositories
it stands.

Offsets come from splitting a text at the matches: the parts between matches and the matches themselves, with
their lengths in code points, add up to the start of each match. The sums run in blocks of matches, so that the
work grows with the matches of a text and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import written

#: Kinds with the fixed definition, in their order: pattern, and what a match must have to count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = ("assign", "access", "hex")
#: The method's own kind: tokens of many characters that no fixed kind covers.
EXTRA_KIND = "token"
KINDS = (*BASE_KINDS, EXTRA_KIND)
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{24,}", "token": r"(?:gh[pousr]_|github_pat_|sk_live_|sk-|xox[abp]-|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,}"}
MIN_SECRET = 6
MIN_ACCESS = 20
#: Matches whose lengths are summed at a time.
BLOCK = 128

SPAN = "struct<kind: string, start: int, end: int, value: string>"
FOUND = "struct<kind: string, start: int, end: int, value: string, owners: bigint, repositories: bigint, live: boolean>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in functions the body names it."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern, leftmost and without overlap, as structs (kind, start, end, value)."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)  # one part more than there are matches
    pairs = F.filter(F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit"))), lambda p: p["hit"].isNotNull())

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + pair["size"]).alias("end"), pair["hit"].alias("value"))
        return F.struct((start + pair["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(acc: Column, some: Column) -> Column:
        one = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")), step)
        return let(one, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["spans"])).alias("parts")))

    def summed(all_pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_pairs) - 1, F.lit(BLOCK)), lambda k: F.slice(all_pairs, k + 1, BLOCK))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
        return F.aggregate(blocks, nothing, block, lambda acc: F.flatten(acc["parts"]))

    return let(pairs, lambda p: F.when(F.size(p) > 0, summed(p)).otherwise(F.array().cast(f"array<{SPAN}>")))


def candidates(text: Column, kind: str) -> Column:
    """Spans of one kind that count; matches that fail are dropped. Texts without a match are not split."""
    spans = located(text, kind)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_SECRET)
    elif kind == "access":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= MIN_ACCESS)
    return F.when(text.rlike(PATTERNS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_part(span: Column) -> Column:
    """What is hashed: the value behind the equals sign, or the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def looks_alive(value: Column) -> Column:
    """``MIN_SECRET`` characters or more, half of them of different kinds (six kinds do), with a digit and a letter, and no placeholder word."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= MIN_SECRET) & (kinds >= F.least(F.lit(6), F.ceil(F.length(value) / 2))) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("(?i)example|changeme|placeholder|your|dummy|sample|xxxx")


def _exploded(rows: DataFrame) -> DataFrame:
    """uid, owner, repo, value, its hash and the span, of each candidate of each row."""
    each = rows.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("uid", "owner", "repo", F.explode(F.concat(*KINDS)).alias("span"))
    return each.withColumn("value", secret_part(F.col("span"))).withColumn("h", F.md5(F.col("value").cast("binary")))


def _owned(each: DataFrame) -> DataFrame:
    """h, owners, repositories: distinct ones over the whole corpus; all null owners are one owner.

    The distinct uses come first, so that a value of very many documents never meets in one task.
    """
    uses = each.select("h", F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit("?")).alias("owner"), F.coalesce(F.concat(F.lit("="), F.col("repo")), F.lit("?")).alias("repo"))
    return uses.groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repositories"))


def _spans(rows: DataFrame, most_owners: int) -> DataFrame:
    """uid and ``spans`` (``FOUND``) of the rows that have any: all spans of the fixed kinds, and the tokens that are live and overlap none of these."""
    each = _exploded(rows)
    live = looks_alive(F.col("value")) & (F.col("owners") <= most_owners)
    each = each.join(_owned(each), "h").select("uid", "span", "owners", "repositories", live.alias("live"))
    # In order of start: a token overlaps a fixed span if one that comes before it ends behind its start, or one that
    # comes later begins before its end. Both are running values, one from each side.
    fixed, order = F.col("span.kind") != EXTRA_KIND, [F.col(f"span.{c}") for c in ("start", "end", "kind")]
    running = lambda order: Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(fixed, F.col("span.end"))).over(running(order))
    after = F.min(F.when(fixed, F.col("span.start"))).over(running([c.desc() for c in order]))
    each = each.withColumns({"fixed": fixed, "before": before, "after": after})
    apart = F.coalesce(F.col("before") <= F.col("span.start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("span.end"), F.lit(True))
    span = F.struct("span.start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("span.kind")).alias("place"), "span.kind", "span.end", "span.value", "owners", "repositories", "live")
    found = each.where(F.col("fixed") | (F.col("live") & apart)).groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    ordered = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "value", "owners", "repositories", "live"))))
    return found.select("uid", ordered.alias("spans"))


def _scanned(docs: DataFrame, owner_col: str, id_col: str, text_col: str, keep: list[Column], name: str) -> DataFrame:
    """uid, owner, repo, the candidates by kind and ``keep`` of each row, written once, so that the number of a row stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.col(id_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), *(candidates(text, k).alias(k) for k in KINDS))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), name)


def scan_secrets(docs: DataFrame, owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text", most_owners: int = 2) -> DataFrame:
    """One row for each document: doc_id, ``spans`` and ``live`` (those of the spans that are live).

    A span is (kind, start, end, value, owners, repositories, live), by start, then kind; offsets are in code
    points, end exclusive. ``spans`` has all spans of the fixed kinds and the tokens that are live and overlap none
    of these. A candidate is live if it looks alive and the whole corpus has it with at most ``most_owners``
    owners, whatever the number of their documents (``repositories``: documents by id); null owners count as one
    owner. A null text is empty; rows are kept one by one whatever their ids; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = _scanned(docs, owner_col, id_col, text_col, [F.col(id_col).alias("doc_id")], "secrets")
    out = rows.select("uid", "doc_id").join(_spans(rows, most_owners), "uid", "left")
    spans = F.coalesce("spans", F.array().cast(f"array<{FOUND}>"))
    return out.select("doc_id", spans.alias("spans"), F.filter(spans, lambda s: s["live"]).alias("live"))


def ownership(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each candidate's hash: kind, occurrences, distinct repositories and owners (null ones not counted), alive."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"))
    each = rows.select("repo", "owner", F.explode(F.concat(*[candidates(text, k) for k in KINDS])).alias("span"))
    each = each.withColumn("value", secret_part(F.col("span")))
    return each.groupBy(F.md5(F.col("value").cast("binary")).alias("hash")).agg(F.min("span.kind").alias("kind"), F.count("*").alias("occurrences"), F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"), F.bool_or(looks_alive(F.col("value"))).alias("alive"))


def redact(docs: DataFrame, mark: str = "[secret]", owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text", most_owners: int = 2) -> DataFrame:
    """The documents with the values of their live spans replaced in the text; all rows and columns stay.

    The same value is replaced wherever it stands in the row's text. Rows are taken one by one, whatever their
    ids. Only rows with a candidate are joined; the others pass without a shuffle.
    """
    rows = _scanned(docs, owner_col, id_col, text_col, [F.struct(*docs.columns).alias("row")], "secrets")
    found = _spans(rows, most_owners).select("uid", F.array_distinct(F.transform(F.filter("spans", lambda s: s["live"]), secret_part)).alias("values")).where(F.size("values") > 0)
    some = " OR ".join(f"size({k}) > 0" for k in KINDS)
    text = F.col("row")[text_col]
    longest = F.array_sort("values", lambda x, y: F.signum(F.length(y) - F.length(x)).cast("int"))
    clean = F.coalesce(F.aggregate(longest, text, lambda acc, v: F.replace(acc, v, F.lit(mark))), text)
    joined = rows.where(some).select("uid", "row").join(found, "uid", "left").select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    return rows.where(f"NOT ({some})").select("row.*").unionByName(joined)
