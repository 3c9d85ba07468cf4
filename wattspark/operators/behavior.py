"""What clusters, outliers and devices mean: rule-based labels and profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.functions import rules
from wattspark.operators.common import attach_one_row, settle
from wattspark.operators.quantiles import quantile_row
from wattspark.operators.stats import top_k
from wattspark.schema import ALL_LABELS, OUTLIER, POWER, share_column


def cluster_stats(df: DataFrame) -> DataFrame:
    """Non-noise clusters: mean and sample variance of power, mean delta, rows."""
    return (
        df.where(F.col("cluster") != -1)
        .groupBy("cluster")
        .agg(
            F.avg(POWER).alias("avg_power"),
            F.var_samp(POWER).alias("power_var"),
            F.avg("power_delta").alias("avg_delta"),
            F.count(F.lit(1)).alias("point_count"),
        )
    )


def cluster_share(stats: DataFrame, df: DataFrame) -> DataFrame:
    """Add the percentage of all rows, noise included."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        attach_one_row(stats, total)
        .withColumn("pct_of_total", F.col("point_count") / F.col("_total") * 100)
        .drop("_total")
    )


def cluster_census(df: DataFrame) -> DataFrame:
    """Number of clusters, number and percentage of noise rows."""
    noise = F.col("cluster") == -1
    return df.agg(
        F.count_distinct(F.when(~noise, F.col("cluster"))).alias("n_clusters"),
        F.count_if(noise).alias("n_outliers"),
        (F.avg(noise.cast("double")) * 100).alias("outlier_pct"),
    )


def behavior_label_v2(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "behavior_label", rules.behavior_v2(F.col("avg_power"), F.col("power_var"))
    )


def behavior_label_final(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "behavior_label", rules.behavior_final(F.col("avg_power"), F.col("power_var"))
    )


def map_cluster_label(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the label of each row's cluster; noise becomes 'Outlier'."""
    labels = settle(stats.select("cluster", "behavior_label"))
    joined = df.join(labels, "cluster", "left")
    return joined.withColumn(
        "behavior_label",
        F.when(F.col("cluster") == -1, OUTLIER).otherwise(F.col("behavior_label")),
    )


def _p95(df: DataFrame, q: float) -> DataFrame:
    """The q-quantiles of power and absolute delta over all rows, as one row."""
    power = quantile_row(df, POWER, [q], ["_p95_power"])
    delta = quantile_row(
        df.select(F.abs("power_delta").alias("_abs_delta")), "_abs_delta", [q], ["_p95_delta"]
    )
    return power.crossJoin(F.broadcast(delta))


def _typed_outliers(df: DataFrame, rule, q: float, **cuts) -> DataFrame:
    marked = attach_one_row(df, _p95(df, q))
    kind = rule(
        F.col(POWER), F.col("power_delta"), F.col("_p95_power"), F.col("_p95_delta"), **cuts
    )
    return marked.withColumn("outlier_type", F.when(F.col("cluster") == -1, kind)).drop(
        "_p95_power", "_p95_delta"
    )


def outlier_type_v2(df: DataFrame, q: float = 0.95) -> DataFrame:
    """Add `outlier_type` for noise rows, NULL for others."""
    return _typed_outliers(df, rules.outlier_v2, q)


def outlier_type_final(df: DataFrame, q: float = 0.95, low: float = 20, jump: float = 10) -> DataFrame:
    return _typed_outliers(df, rules.outlier_final, q, low=low, jump=jump)


def relabel_outliers(df: DataFrame) -> DataFrame:
    """Noise rows take their outlier type as behaviour label."""
    return df.withColumn(
        "behavior_label",
        F.when(F.col("cluster") == -1, F.col("outlier_type")).otherwise(F.col("behavior_label")),
    )


def label_behavior(df: DataFrame, final: bool = True) -> DataFrame:
    """All labelling steps for a clustered table."""
    stats = cluster_stats(df)
    stats = behavior_label_final(stats) if final else behavior_label_v2(stats)
    typed = outlier_type_final(df) if final else outlier_type_v2(df)
    return relabel_outliers(map_cluster_label(typed, stats))


def outlier_type_counts(df: DataFrame) -> DataFrame:
    counts = (
        df.where(F.col("cluster") == -1)
        .groupBy("outlier_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), "outlier_type")


def _top_noise(df: DataFrame, key: str, n: int) -> DataFrame:
    counts = df.where(F.col("cluster") == -1).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, "n", n, [key])


def top_outlier_gpus(df: DataFrame, n: int = 5) -> DataFrame:
    return _top_noise(df, "gpu_id", n)


def top_outlier_hours(df: DataFrame, n: int = 3) -> DataFrame:
    return _top_noise(df, "hour", n)


def outliers_per_hour(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster") == -1).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


def gpu_profile(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Per device: mean and variance of power and the share of time in each known label."""
    shares = [
        (F.avg(F.when(F.col("behavior_label") == label, 1.0).otherwise(0.0)) * 100).alias(
            share_column(label)
        )
        for label in labels or ALL_LABELS
    ]
    return df.groupBy("gpu_id").agg(
        F.avg(POWER).alias("power_watts_mean"), F.var_samp(POWER).alias("power_watts_var"), *shares
    )


def label_share_map(df: DataFrame) -> DataFrame:
    """Per device a map label -> share of rows (the map has at most as many keys as labels)."""
    counts = df.groupBy("gpu_id", "behavior_label").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("behavior_label", "n")))
    return (
        counts.where(F.col("behavior_label").isNotNull())
        .groupBy("gpu_id")
        .agg(entries.alias("e"), F.sum("n").alias("total"))
        .select(
            "gpu_id",
            F.map_from_entries(
                F.transform("e", lambda x: F.struct(x["behavior_label"], x["n"] / F.col("total")))
            ).alias("label_share"),
        )
    )


def gpu_class_v2(profile: DataFrame) -> DataFrame:
    return profile.withColumn("gpu_classification", rules.gpu_class_rule(with_extreme=False))


def gpu_class_final(profile: DataFrame) -> DataFrame:
    return profile.withColumn("gpu_classification", rules.gpu_class_rule(with_extreme=True))


def class_counts(profile: DataFrame, n: int = 5) -> DataFrame:
    """Devices per class, with the first n unstable devices as text on their row."""
    counts = profile.groupBy("gpu_classification").agg(F.count(F.lit(1)).alias("n"))
    examples = (
        profile.where(F.col("gpu_classification") == "Unstable / Spiky")
        .orderBy("gpu_id")
        .limit(n)
        .agg(F.array_join(F.array_sort(F.collect_list("gpu_id")), ",").alias("_examples"))
    )
    return attach_one_row(counts, examples).select(
        "gpu_classification",
        "n",
        F.when(F.col("gpu_classification") == "Unstable / Spiky", F.col("_examples")).alias(
            "examples"
        ),
    )


def peak_transition(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Percentage of rows per label for peak and non-peak rows (missing = 0), long form."""
    wide = df.groupBy("is_peak").agg(
        *[
            (F.avg(F.when(F.col("behavior_label") == x, 1.0).otherwise(0.0)) * 100).alias(f"_{i}")
            for i, x in enumerate(labels or ALL_LABELS)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(x).alias("behavior_label"), F.col(f"_{i}").alias("pct"))
            for i, x in enumerate(labels or ALL_LABELS)
        ]
    )
    return wide.select("is_peak", F.inline(pairs))


def peak_inlier_pct(transition: DataFrame) -> DataFrame:
    """Per peak flag: everything that is not a Spike Event."""
    return transition.groupBy("is_peak").agg(
        (
            F.sum("pct") - F.sum(F.when(F.col("behavior_label") == "Spike Event", F.col("pct")))
        ).alias("non_spike_pct")
    )


def top_gpu_rows(df: DataFrame, profile: DataFrame, n: int = 20) -> DataFrame:
    """Rows of the n devices with the highest mean power."""
    best = top_k(profile, "power_watts_mean", n, ["gpu_id"]).select("gpu_id")
    return df.join(F.broadcast(best), "gpu_id", "left_semi")


def gpu_behavior_heatmap(df: DataFrame, profile: DataFrame, n: int = 20) -> DataFrame:
    """Label percentages of the top devices, one column per label."""
    rows = top_gpu_rows(df, profile, n)
    return rows.groupBy("gpu_id").agg(
        *[
            (F.avg(F.when(F.col("behavior_label") == x, 1.0).otherwise(0.0)) * 100).alias(
                share_column(x)
            )
            for x in ALL_LABELS
        ]
    )
