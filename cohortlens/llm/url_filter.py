"""URL filter: listed rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path start; it fits the host and its subdomains, and the longest fitting rule
decides.  The trees learn from labelled URLs (by default those that a rule decides) and judge the
rest.  Features: lengths, depth, digit ratio, entropy, parameter counts, and smoothed block rates of
the URL's top-level label, its first path part and its last path part's shape ("suffix statistics").
Suffix rates come from all labelled URLs.  A labelled URL's own rates leave out its fold of the URLs, itself
included: otherwise a suffix of one URL would give its label away, and the trees would read it from there.
The trees are fitted on labelled pages drawn by a hash, ``TRAIN_ROWS`` of them on average; pages of one URL are one
weighted row, so a hot URL takes a part of the sample's weight and one of its rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path; of equally long fitting rules
the later one decides; without labels
of both kinds the model gives the only kind there is, or ``allow``; repeated rows get equal rows;
an empty table gives an empty result; other columns are not looked at.  Very long URLs are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import lower_ascii
from cohortlens.runtime import materialise

#: Fixed values of the query: verdict, host, path start.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRAIN_ROWS = 200_000
TREES, DEPTH, STEP = 20, 4, 0.2
FOLDS = 8  # of URLs, for the rates of labelled ones
SMOOTHING = 20.0  # labelled URLs that the overall rate counts for in a suffix rate

SUFFIXES = ("top", "site", "first_part", "last_shape", "query_keys")
NUMBERS = (
    "n_url", "n_host", "n_path", "n_query", "depth", "labels", "n_params", "hyphens", "digit_ratio", "entropy", "https", "fragment",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own characters."""
    chars = F.split(text, "")
    n = F.length(text)
    each = F.transform(F.array_distinct(chars), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))).otherwise(0.0)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages`` (with host and path) and the features that need no other row."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.split(F.col("path"), "/")
    last = F.element_at(parts, -1)
    return pages.withColumns({
        "n_url": F.length(url), "n_host": F.length("host"), "n_path": F.length("path"), "n_query": F.length(query),
        "depth": _matches(F.col("path"), "/[^/]"), "labels": _matches(F.col("host"), "[^.]+"),
        "n_params": _matches(query, "[^&=]+="), "hyphens": _matches(F.col("host"), "-"),
        "digit_ratio": _matches(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "https": url.startswith("https").cast("int"), "fragment": F.contains(url, F.lit("#")).cast("int"),
        "top": F.regexp_extract("host", r"([^.]*)$", 1), "site": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1),
        "first_part": F.coalesce(F.get(parts, F.lit(1)), F.lit("")),
        "last_shape": F.regexp_replace(F.regexp_replace(last, "[0-9]+", "0"), "[a-z]+", "a"),
        "query_keys": F.regexp_replace(query, "=[^&]*", "="),
    })


def _rates(features: DataFrame, base: float) -> dict[str, DataFrame]:
    """Per suffix column: share of blocked labelled URLs, drawn towards the overall share; ``of_all`` and, leaving out one fold
    each, ``without``."""
    known = features.where("label IS NOT NULL")

    def rate(blocked: Column, n: Column) -> Column:
        return (blocked + SMOOTHING * base) / (n + SMOOTHING)

    out = {}
    for c in SUFFIXES:
        inside = [F.when(F.col("fold") == k, F.col("label")) for k in range(FOLDS)]
        without = [rate(F.sum("label") - F.coalesce(F.sum(x), F.lit(0.0)), F.count("label") - F.count(x)) for x in inside]
        out[c] = known.groupBy(c).agg(rate(F.sum("label"), F.count("label")).alias("of_all"), F.array(*without).alias("without"))
    return out


def _with_rates(features: DataFrame, base: float) -> DataFrame:
    """``rate_*`` columns: without their own fold for labelled URLs, of all labelled URLs for the others."""
    def joined(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        own = F.when(F.col("label").isNotNull(), F.col("without")[F.col("fold")]).otherwise(F.col("of_all"))
        return df.join(item[1], item[0], "left").withColumn(f"rate_{item[0]}", F.coalesce(own, F.lit(base))).drop("of_all", "without")

    return reduce(joined, _rates(features, base).items(), features)


def judge(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page.

    ``labels (page_id, label)`` gives 1 for a URL to block; without it the rules' verdicts are the labels.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("r", rule_column(F.col("host"), F.col("path"), rules)).withColumns(
        {"rule": F.col("r.rule"), "given": F.col("r.verdict")}
    ).drop("r")
    if labels is None:
        known = ruled.withColumn("label", F.when(F.col("given") == "block", 1.0).when(F.col("given") == "allow", 0.0))
    else:
        one = labels.groupBy(F.col("page_id").alias("__p")).agg(F.max("label").cast("double").alias("label"))
        known = ruled.join(one, ruled["page_id"] == one["__p"], "left").drop("__p")
    fold = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS)).cast("int")
    features = materialise(lexical_features(known).withColumn("fold", fold), "url-features")
    n, blocked = features.agg(F.count("label"), F.sum("label")).first()
    if not n or blocked in (0, n):
        score = F.lit(1.0 if n and blocked else 0.0)
        scored = features.withColumn("score", score)
    else:
        full = _with_rates(features, blocked / n)
        columns = [*NUMBERS, *(f"rate_{c}" for c in SUFFIXES)]
        vectors = materialise(VectorAssembler(inputCols=columns, outputCol="v").transform(full).select(
            "page_id", "host", "path", "rule", "given", "label", vector_to_array("v").alias("a"), F.xxhash64("url").alias("h"),
            F.xxhash64("page_id", "url").alias("draw"),
        ), "url-vectors")
        packed = _as_vectors(vectors, len(columns))
        taken = F.col("draw") / F.lit(2.0**64) + 0.5 <= train_rows / n
        one = vectors.where("label IS NOT NULL").where(taken).groupBy("h", "label").agg(
            F.first("a").alias("a"), F.count(F.lit(1)).cast("double").alias("rows"))
        train = _as_vectors(one, len(columns)).select("label", "rows", "v")
        model = GBTClassifier(
            featuresCol="v", labelCol="label", weightCol="rows", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(train)
        scored = model.transform(packed).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _as_vectors(table: DataFrame, n: int) -> DataFrame:
    names = [f"__f{i}" for i in range(n)]
    wide = table.withColumns({c: F.col("a")[i] for i, c in enumerate(names)})
    return VectorAssembler(inputCols=names, outputCol="v").transform(wide).drop("a", *names)
