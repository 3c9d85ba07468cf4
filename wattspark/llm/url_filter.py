"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions and the JVM-side learners are used. The model is fitted on a small labelled
URL table (at most `LABELLED` rows; more raise an error) in one partition, so its sums do not depend
on the layout; scoring is one pass over the pages without a shuffle.

Rules are a short list: each becomes a condition, tried from the longest to the shortest.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is
judged by the model on no features; repeated rows give repeated results; of rules of equal length
the alphabetically first wins; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import free_name

LABELLED = 5_000
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. rules: (host/path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        own = text.split("/", 1)[0]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(text[len(own) :]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    bounded = F.concat(F.lit("^"), F.translate(text, _UPPER, _LOWER), F.lit("$"))
    length = F.char_length(bounded)

    def of(n: int) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), length - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(bounded, i, F.lit(n))))

    return F.when(text != "", F.concat(*(of(n) for n in SIZES))).otherwise(F.array().cast("array<string>"))


def with_grams(df: DataFrame, host: Column, path: Column, out: str) -> DataFrame:
    """Adds the character n-grams of host and path, marked by where they come from."""
    return df.withColumn(out, F.concat(_grams(host, "h"), _grams(path, "p")))


def _hashed(grams: str, out: str) -> HashingTF:
    return HashingTF(inputCol=grams, outputCol=out, numFeatures=BUCKETS, binary=True)


def fit(labelled: DataFrame, url: str = "url", label: str = "label", regularisation: float = 0.01, steps: int = 60) -> LogisticRegressionModel:
    """The model of a small labelled URL table; label 1: block."""
    n = labelled.limit(LABELLED + 1).count()
    if n > LABELLED:
        raise ValueError(f"the labelled table has more than {LABELLED} rows")
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("label is not null")
    rows = with_grams(rows, host_of(F.col("url")), path_of(F.col("url")), "grams").coalesce(1).sortWithinPartitions("url", "label")
    return LogisticRegression(featuresCol="features", maxIter=steps, regParam=regularisation, standardization=False).fit(
        _hashed("grams", "features").transform(rows)
    )


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict and score (the model's probability of `block`)."""
    names = {c: free_name(pages, c) for c in ("_grams", "_features", "_raw", "_probability", "_prediction")}
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    df = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = with_grams(df, F.col("host"), F.col("path"), names["_grams"])
    df = _hashed(names["_grams"], names["_features"]).transform(df)
    scorer = model.copy()
    scorer.setFeaturesCol(names["_features"]).setRawPredictionCol(names["_raw"]).setProbabilityCol(names["_probability"])
    scorer.setPredictionCol(names["_prediction"])
    df = scorer.transform(df)
    learned = F.when(F.col(names["_prediction"]) == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, learned)).drop(*names.values())


def seed_labels(pages: DataFrame, unwanted: list[str], url: str = "url", sample: int = 2_000) -> DataFrame:
    """A small labelled table: `sample` distinct urls of `pages`, in the order of their hash, with label
    1 where a part of the host (between dots and hyphens) is one of the unwanted words, else 0."""
    parts = F.split(host_of(F.col("url")), r"[.-]")
    bad = reduce(lambda a, b: a | b, (F.array_contains(parts, w) for w in unwanted))
    urls = pages.select(F.col(f"`{url}`").alias("url")).where("url is not null").distinct()
    return urls.orderBy(F.xxhash64("url"), "url").limit(sample).withColumn("label", bad.cast("int"))
