"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Labels of one's own may say something about a whole suffix (the last two labels of a host), so the share of blocked
ones is a feature; for training it comes from the other tenths of the labelled urls. Labels that come from rules
say nothing about pages that the rules leave open: the trees would learn the rules' hosts by heart. With these,
a suffix has no such feature, and its pages are scored by trees that were fit on the other suffixes' urls only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import written

#: (host, path, verdict): a rule fits its host and all subdomains of it, where the url's path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_path", "f_suffix_log", "f_suffix_rate")


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def rule_of(host: F.Column, path: F.Column, rules) -> tuple[F.Column, F.Column]:
    """The longest rule that fits (the earlier of two as long) and its verdict, null if none. For rule lists of bounded length, as code."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of ``url`` (null: those of an empty one), ``host`` and ``path`` that need no other row."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    labels = F.split("host", r"\.")
    suffix = F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host"))
    return df.withColumns({
        "f_length": n, "f_depth": F.regexp_count("path", F.lit("/")).cast("double"), "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n, "f_entropy": entropy,
        "f_params": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"), "f_labels": F.size(labels).cast("double"), "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"), "f_path": F.length("path").cast("double"), "suffix": suffix,
    })


#: A url is blocked if the trees are so sure, and if at least this share of the labelled urls that they are so sure of is blocked.
BLOCK_SCORE, HELD_OUT = 0.8, 0.8
#: Groups of suffixes, for labels from rules, and parts of the labelled urls, for suffix rates.
FOLDS, PARTS = 3, 10


def _rates(known: DataFrame, mean: float) -> DataFrame:
    """suffix, part, f_suffix_rate: the smoothed share of blocked urls in all parts but this one; in all of them for the null part."""
    counts = known.groupBy("suffix", "part").agg(F.count("*").alias("k"), F.sum("blocked").alias("b"))
    whole = counts.groupBy("suffix").agg(F.sum("k").alias("all_k"), F.sum("b").alias("all_b"))
    rate = lambda b, k: ((b + 5 * mean) / (k + 5)).alias("f_suffix_rate")
    each = counts.join(whole, "suffix").select("suffix", "part", rate(F.col("all_b") - F.col("b"), F.col("all_k") - F.col("k")))
    return each.unionByName(whole.select("suffix", F.lit(None).cast("long").alias("part"), rate(F.col("all_b"), F.col("all_k"))))


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_train_rows: int = 20_000, id_col: str = "page_id", url_col: str = "url", trees: int = 8, depth: int = 3) -> DataFrame:
    """One row for each page: page_id, url, host, path, rule, score (of block, 0 to 1) and verdict (allow or block).

    The trees learn from labelled urls: ``labelled`` (url, verdict), or else those that a rule decides. They
    are fit on a sample of at most ``max_train_rows`` of these, chosen by a hash of the url; suffix statistics
    (pages with the suffix, share of labelled ones blocked) cover all rows. A rule's verdict always stands; its
    score is what the trees alone would say. A page is blocked by the trees from ``BLOCK_SCORE`` on. Where these
    have no labels, or only labels of one class, the score is that class's if ``labelled`` was given, and else 0:
    rules of one kind are no evidence against other suffixes. With labels from rules the trees are also tried on the
    sampled labels of the suffixes that they have not seen: if under ``HELD_OUT`` of those that they would block are
    blocked, they have learned nothing that carries over, and block nothing. Null urls count as empty. Equal rows get equal
    verdicts, rows are judged one by one, urls of any length are read whole, other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "said": said}))
    own = labelled is not None
    if own:
        known = labelled.select(F.col("url").cast("string").alias("url"), F.col("verdict").alias("said")).withColumns({"host": host, "path": path})
        known = lexical(known)
    else:
        known = rows
    used = FEATURES if own else tuple(f for f in FEATURES if f != "f_suffix_rate")
    fold = F.lit(0) if own else F.pmod(F.xxhash64("suffix"), F.lit(FOLDS)).cast("int")
    known = known.where(F.col("said").isNotNull()).withColumns({"blocked": (F.col("said") == "block").cast("double"), "part": F.pmod(F.xxhash64("url"), F.lit(PARTS)), "fold": fold})
    known = known.select("url", "suffix", "blocked", "part", "fold", *FEATURES[:-2])
    n, mean = known.agg(F.count("*"), F.coalesce(F.avg("blocked"), F.lit(0.0))).first()
    # Pages with the suffix, in steps of ten times: the exact number would name the suffix.
    stats = rows.groupBy("suffix").agg(F.floor(F.log10(F.count("*"))).cast("double").alias("f_suffix_log"))
    share = min(1.0, 0.95 * max_train_rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(max_train_rows)
    sample, rows = sample.join(stats, "suffix", "left"), rows.withColumn("fold", fold).join(stats, "suffix", "left")
    if own:
        rates = _rates(known, mean)
        sample = sample.join(rates, ["suffix", "part"], "left")
        rows = rows.join(rates.where("part IS NULL").drop("part"), "suffix", "left")
    fill = {"f_suffix_log": 0.0, "f_suffix_rate": mean}
    sample, rows = (x.fillna({k: v for k, v in fill.items() if k in used}) for x in (sample, rows))
    make = VectorAssembler(inputCols=list(used), outputCol="features")
    train = written(sample.select("fold", F.col("blocked").alias("label"), *used), "url-labels")  # max_train_rows at most
    counts = {r["fold"]: (r["n"], r["b"]) for r in train.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("b")).collect()}
    scored, score, held = make.transform(rows), F.lit(0.0), None
    for k in range(1 if own else FOLDS):
        others = [c for f, c in counts.items() if own or f != k]
        total, bad = sum(c[0] for c in others), sum(c[1] for c in others)
        if 0 < bad < total:
            some = make.transform(train if own else train.where(F.col("fold") != k)).select("label", "features")
            model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(some.coalesce(4))
            scored = model.setRawPredictionCol(f"raw{k}").setProbabilityCol(f"p{k}").setPredictionCol(f"c{k}").transform(scored)
            value = vector_to_array(f"p{k}")[1]
            if not own:
                tried = model.transform(make.transform(train.where(F.col("fold") == k))).select("label", value.alias("score"))
                held = tried if held is None else held.unionByName(tried)
        else:
            value = F.lit(1.0 if own and bad else 0.0)
        score = F.when(F.col("fold") == k, value).otherwise(score)
    sure = F.col("score") >= BLOCK_SCORE
    trusted = own
    if held is not None:
        asked, right = held.agg(F.count_if(sure), F.count_if(sure & (F.col("label") == 1))).first()
        trusted = right > 0 and right >= HELD_OUT * asked
    scored = scored.withColumn("score", score)
    verdict = F.coalesce("said", F.when(sure & F.lit(trusted), "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))
