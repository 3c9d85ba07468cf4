"""Quality rules whose cutoffs are certified on labelled holdouts.

Every document is measured once (`measure`). A rule rejects a document when one of its measures
lies beyond a cutoff. The cutoffs are not set by hand: for each stratum (by default the language)
one fixed sequence of joint cutoffs, all rules together, is tested on the labelled documents from the
most lenient to the strictest (`STEPS` steps; at each, a rule stands at the same share of its list of
candidates). A step is certified when the exact binomial test rejects "this step rejects more than
`alpha` of the good documents" at the level `delta / strata`; the sequence stops at its first failure
(fixed-sequence testing), which keeps the family-wise error of a stratum at its level, and the
Bonferroni split over strata keeps the error of all of them at `delta`. So, with confidence
1 - delta, no stratum loses more than `alpha` of its good documents to the rules.

Cutoffs no stricter than a certified step's reject no document that the step keeps, so the guarantee
covers every choice among them, also one made on the same labels: each rule takes the most lenient
candidate up to that step with the largest surplus of labelled bad over labelled good rejections, and
a rule without a surplus stays unused. A stratum needs `least_labels(alpha, delta / strata)` good labels (217 with the
defaults and four strata) to certify anything; with fewer it rejects nothing beyond the base rule.

The labelled documents are counted, not collected: rows shrink to (stratum, rule, candidate) counts
with map-side aggregation; the search for cutoffs reads at most `candidates` rows per rule and runs
per stratum. All labels are used. The cutoffs (one row per stratum) are joined back.

Defined cases: null and empty texts have zero measures and fail the base rule; a null stratum is a
stratum; labels without a document and documents without a label only do not calibrate; repeated
label rows count as often as they stand; a null label is no label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.common import free_name, give_back, text_of
from wattspark.operators.common import settle

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_MEASURED = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES])
_SYMBOLS = "#*$%&|<>"

# A rule: its measure as an expression of the counts, and candidate cutoffs from lenient to strict.
# A document is rejected when the measure is above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35]),
    "word_length": ("word_chars / greatest(n_words, 1)", [20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0]),
}
STEPS = max(len(cuts) for _, cuts in RULES.values())
JOINT = "joint"  # the name of the sequence of joint cutoffs among the counts


def place(rule: str, step: int) -> int:
    """Index of the rule's candidate at a step of the joint sequence."""
    n = len(RULES[rule][1])
    return -(-(step + 1) * n // STEPS) - 1


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice, first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    starts = np.fromiter(map(counts.__getitem__, windows), np.int64, len(windows)) > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= starts
    return int(covered.sum())


@F.arrow_udf(_MEASURED)
def _measure(texts: pa.Array) -> pa.Array:
    rows = []
    for value in texts:
        text = value.as_py() or ""
        data = text.encode("utf-8", "replace")
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip()]
        blanks = sum(map(text.count, " \t\n\v\f\r"))
        rows.append(
            (
                len(words),
                len(text) - blanks,
                sum(map(text.count, _SYMBOLS)),
                len(lines) - len(set(lines)),
                repeated_words(words),
                len(lines),
            )
        )
    give_back()
    columns = zip(*rows) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measure(text: str = "text") -> Column:
    """The counts of a whole text, as one struct.

    Declared non-deterministic (it is not) so that a filter on the counts is not pushed below the
    step, which would measure every text twice.
    """
    return _measure.asNondeterministic()(text_of(text))


def base_failed(m: str) -> Column:
    """Fewer than 50 words, or more than half of the words inside repeated windows."""
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def rule_value(rule: str, m: str) -> Column:
    """The measure of a rule over the counts in struct column `m`."""
    names = "|".join(MEASURES)
    return F.expr(re.sub(rf"\b({names})\b", rf"`{m}`.`\1`", RULES[rule][0]))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    return min(1.0, math.fsum(map(math.exp, logs)))


def least_labels(risk: float, level: float) -> int:
    """The least number of good labels with which a step that rejects none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def certified(good: list[int], n_good: int, risk: float, level: float) -> int:
    """Index of the last certified step, or -1. good: good documents rejected at each step, lenient first."""
    last = -1
    for g in good:
        if n_good == 0 or tail(g, n_good, risk) > level:
            break
        last += 1
    return last


def most_useful(good: list[int], bad: list[int]) -> int:
    """Index of the most lenient candidate with the largest surplus of bad over good, or -1 without one."""
    best, gain = -1, 0
    for i, (g, b) in enumerate(zip(good, bad)):
        if b - g > gain:
            best, gain = i, b - g
    return best


def calibrate(
    measured: DataFrame, labels: DataFrame, key: str, m: str, stratum: str, alpha: float = 0.02, delta: float = 0.05
) -> DataFrame:
    """One row per labelled stratum: `stratum` and a cutoff (or null) per rule.

    `measured` has `key`, `stratum` and the struct `m`; `labels` has `key` and `quality` (1: good).
    Documents that the base rule rejects are not counted: they are not the rules' to reject.
    """
    known = labels.where(F.col("quality").isNotNull()).select(F.col(key), (F.col("quality") > 0).alias("_good"))
    # n: how many of the rule's cutoffs lie below the measure; these, the strictest n, reject the document.
    # So do the strictest n steps of the joint sequence.
    beyond = [
        F.struct(F.lit(r).alias("rule"), sum(((rule_value(r, m) > c).cast("int") for c in cuts), F.lit(0)).alias("n"))
        for r, (_, cuts) in RULES.items()
    ]
    joint = [reduce(or_, (rule_value(r, m) > cuts[place(r, t)] for r, (_, cuts) in RULES.items())) for t in range(STEPS)]
    beyond.append(F.struct(F.lit(JOINT).alias("rule"), sum((hit.cast("int") for hit in joint), F.lit(0)).alias("n")))
    counts = (
        measured.where(~base_failed(m))
        .join(known, key)
        .select(F.col(f"`{stratum}`").cast("string").alias("stratum"), "_good", F.inline(F.array(*beyond)))
        .groupBy("stratum", "rule", "n")
        .agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    )
    strata = counts.agg(F.count_distinct(F.coalesce("stratum", F.lit("\0"))).alias("strata"))
    schema = T.StructType([T.StructField("stratum", T.StringType())] + [T.StructField(r, T.DoubleType()) for r in RULES])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        def rejected(rule: str, quality: str, n: int) -> list[int]:
            own = part[part["rule"] == rule]
            return [int(own.loc[own["n"] >= n - i, quality].sum()) for i in range(n)]

        n_good = int(part.loc[part["rule"] == JOINT, "good"].sum())
        last = certified(rejected(JOINT, "good", STEPS), n_good, alpha, delta / int(part["strata"].iloc[0]))
        row: dict = {"stratum": part["stratum"].iloc[0]}
        for rule, (_, cuts) in RULES.items():
            open_to = place(rule, last) + 1 if last >= 0 else 0
            good, bad = (rejected(rule, q, len(cuts))[:open_to] for q in ("good", "bad"))
            chosen = most_useful(good, bad)
            row[rule] = cuts[chosen] if chosen >= 0 else None
        return pd.DataFrame([row], columns=schema.names).astype({r: "float64" for r in RULES})

    cutoffs = counts.crossJoin(F.broadcast(strata)).groupBy("stratum").applyInPandas(search, schema)
    return cutoffs.select("stratum", *(F.when(~F.isnan(r), F.col(r)).alias(r) for r in RULES))


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, m: str, stratum: str, out: str) -> DataFrame:
    """Adds boolean `out`: false if the base rule or a certified rule of the stratum rejects."""
    c = free_name(measured, "_cutoffs")
    s = free_name(measured, "_stratum")
    side = cutoffs.select(F.col("stratum").alias(s), F.struct(*RULES).alias(c))
    rejected = base_failed(m)
    for r in RULES:
        rejected = rejected | F.coalesce(rule_value(r, m) > F.col(f"{c}.{r}"), F.lit(False))
    joined = measured.join(side, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col(s)), "left")
    return joined.withColumn(out, ~rejected).drop(c, s)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", out: str = "kept", counts: str = "measures", **risk: float
) -> DataFrame:
    """`docs` with the struct `counts` and the boolean `out`.

    The texts are measured twice, once for the labelled documents' counts and once for the verdict;
    nothing but narrow counts is shuffled, so whole texts never move.
    """
    m = free_name(docs, "_m")
    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{stratum}`"), measure(text).alias(m))
    # Stored, the cutoffs have a real size (a row per stratum), and Spark broadcasts them by it.
    cutoffs = settle(calibrate(narrow, labels, key, m, stratum, **risk))
    return apply_cutoffs(docs.withColumn(counts, measure(text)), cutoffs, counts, stratum, out)
