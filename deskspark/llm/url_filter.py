"""URL filter: allow/block rules by host and path, and logistic regression for URLs that no rule fits.

The model is fitted by Spark ML on a small labelled URL table over hashed character n-grams of host and
path, and applied as a column expression, so a filter is one narrow scan without a shuffle. The labelled
table is a parameter; its rows are bounded by MAX_LABELLED, which `fit` checks.

A null URL or one without "://" has an empty host and path, fits no rule and is judged by the model's
intercept, like any text without n-grams. Extra columns are kept; names of results must be free.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.functions.text import let
from deskspark.llm.common import ascii_lower, filled

BUCKETS = 2048
SIZES = (3, 4)
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    intercept: float


#: Words of hosts that mostly carry advertising, gambling, adult or bulk pages, and of plain ones; the
#: labelled table combines them by rule.
BAD_WORDS = (
    "casino", "poker", "slots", "bets", "betting", "jackpot", "pills", "pharma", "cheap", "discount", "viagra",
    "adult", "xxx", "cams", "spam", "farm-links", "ads", "adserver", "track", "tracker", "click", "free", "win",
    "prize", "loans", "replica",
)
GOOD_WORDS = (
    "library", "news", "garden", "school", "museum", "weather", "history", "science", "kitchen", "travel", "forum",
    "docs", "city", "music", "health", "theatre", "river", "there", "other", "nation", "thing", "bread", "them",
    "mountain", "letters", "station",
)
LANGS = ("en", "de", "fr", "es")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """Small labelled table (url, blocked): every word alone and with its neighbours, over all languages and domains."""
    rows = []
    for words, blocked in ((BAD_WORDS, 1.0), (GOOD_WORDS, 0.0)):
        for i, word in enumerate(words):
            hosts = [word, *(f"{word}-{words[(i + k) % len(words)]}" for k in (7, 11))]
            if not blocked:  # plain hosts are the common case
                hosts += [f"{word}{words[(i + k) % len(words)]}" for k in (1, 2, 3, 5, 9, 13)]
            for j, host in enumerate(hosts):
                lead = ("", "www.", "m.", "blog.")[(i + j) % 4]
                end = ("com", "net", "org")[(i + j) % 3]
                rows.append((f"https://{lead}{host}.example.{end}/{LANGS[(i + j) % 4]}/{i * 37 + j}", blocked))
    return spark.createDataFrame(rows, "url string, blocked double")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(filled(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(filled(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Position of the longest rule that fits, or null; a rule fits its host and every subdomain of it."""
    out = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda x: (len(x[1].text), -x[0])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams; host and path have n-grams of their own."""
    def grams(text: Column, part: str, n: int) -> Column:
        def pieces(t: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
            each = F.transform(starts, lambda i: F.pmod(
                F.xxhash64(F.lit(part), t.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
            return F.when(F.length(t) >= n, each).otherwise(F.array().cast("array<int>"))

        return let(text, pieces)

    edged = F.when(host == "", host).otherwise(F.concat(F.lit("."), host, F.lit(".")))
    return F.array_distinct(F.concat(*[grams(t, part, n) for t, part in ((edged, "h"), (path, "p")) for n in SIZES]))


def fit(labelled: DataFrame, reg: float = 0.002, iterations: int = 60) -> UrlModel:
    """Logistic regression from (url, blocked); the rows are put in order, so reruns give the same model."""
    rows = labelled.orderBy("url", "blocked").coalesce(1)
    if rows.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"a labelled URL table holds at most {MAX_LABELLED} rows")
    dense = let(_buckets(host_of(F.col("url")), path_of(F.col("url"))), lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains(b, i).cast("double")))
    train = rows.select(array_to_vector(dense).alias("features"), F.col("blocked").alias("label")).cache()
    try:
        model = LogisticRegression(regParam=reg, maxIter=iterations, standardization=False).fit(train)
    finally:
        train.unpersist()
    return UrlModel(tuple(round(float(x), 9) for x in model.coefficients.toArray()), round(float(model.intercept), 9))


def score(host: Column, path: Column, model: UrlModel) -> Column:
    """Probability that a URL is one to block."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    logit = F.aggregate(_buckets(host, path), F.lit(model.intercept), lambda s, b: s + F.get(weights, b))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 9)


def judge(pages: DataFrame, rules: tuple[Rule, ...], model: UrlModel, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict (allow or block) and the model's probability of a block."""
    found = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    at = rule_of(F.col("host"), F.col("path"), rules)
    names = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array().cast("array<string>")
    says = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    found = found.withColumn("__at", at).withColumn("block_score", score(F.col("host"), F.col("path"), model))
    by_model = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({
        "rule": F.get(names, F.col("__at")), "verdict": F.coalesce(F.get(says, F.col("__at")), by_model),
    }).drop("__at")
