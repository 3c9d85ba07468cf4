"""Recurring spike patterns and summaries of clustered outliers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspark.functions.rules import std_label_of
from wattspark.functions.timefeat import daypart_of, time_bands
from wattspark.operators.common import attach_one_row
from wattspark.operators.quantiles import quantile_row
from wattspark.operators.stats import top_k
from wattspark.schema import POWER

CLUSTER_LABEL = "global_cluster_label"


def modal_value(df: DataFrame, keys: list[str], col: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per group; a tie goes to the smallest value.

    Values are counted first (partial aggregation), so a large group is never one buffer.
    """
    counts = (
        df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col(col).alias("_value")))
    return counts.groupBy(*keys).agg(best["_value"].alias(name or f"modal_{col}"))


def outlier_cluster_summary(
    df: DataFrame, keys: list[str] | None = None, label: str = CLUSTER_LABEL
) -> DataFrame:
    """Per cluster label: mean, min, max, sample std of power, modal hour, frequency."""
    group = [*(keys or []), label]
    numbers = df.groupBy(*group).agg(
        F.avg(POWER).alias("mean_power"),
        F.min(POWER).alias("min_power"),
        F.max(POWER).alias("max_power"),
        F.stddev_samp(POWER).alias("std_power"),
        F.count(POWER).alias("frequency"),
    )
    return numbers.join(modal_value(df, group, "hour"), group, "left")


def outlier_cluster_profile(
    df: DataFrame, keys: list[str] | None = None, label: str = CLUSTER_LABEL
) -> DataFrame:
    """The summary plus the modal day."""
    group = [*(keys or []), label]
    return outlier_cluster_summary(df, keys, label).join(
        modal_value(df, group, "day_num"), group, "left"
    )


def timing_pattern(
    df: DataFrame, keys: list[str] | None = None, label: str = CLUSTER_LABEL, spread: int = 8
) -> DataFrame:
    """Dominant hour, its part of the day, and whether the cluster spans more than `spread` hours."""
    group = [*(keys or []), label]
    hours = df.groupBy(*group).agg(F.count_distinct("hour").cast("int").alias("n_hours"))
    dominant = modal_value(df, group, "hour", "dominant_hour")
    part = daypart_of(F.col("dominant_hour"))
    text = F.concat(
        F.lit("Peaks around "),
        F.col("dominant_hour").cast("string"),
        F.lit(":00 ("),
        part,
        F.lit(")"),
        F.when(F.col("n_hours") > spread, ", widespread usage").otherwise(", concentrated bursts"),
    )
    return hours.join(dominant, group).withColumn("timing_pattern", text)


def std_label(df: DataFrame, col: str = CLUSTER_LABEL) -> DataFrame:
    return df.withColumn("interpretation", std_label_of(F.col(col)))


def subset_spike_share(profile: DataFrame) -> DataFrame:
    """Per subset: high-spike count, its share, mean high power, mean of the cluster deviations."""
    high = F.col("interpretation") == "High spike cluster"
    high_count = F.coalesce(F.sum(F.when(high, F.col("frequency"))), F.lit(0))
    return profile.groupBy("subset").agg(
        high_count.alias("high_count"),
        (high_count / F.sum("frequency")).alias("high_ratio"),
        F.coalesce(F.avg(F.when(high, F.col("mean_power"))), F.lit(0.0)).alias("avg_high_power"),
        F.avg("std_power").alias("variability"),
    )


def subset_spike_extremes(share: DataFrame) -> DataFrame:
    """Subset with most high spikes, and the most and least variable one (ties: first)."""
    variable = F.col("variability").isNotNull()
    return share.agg(
        F.min(F.struct(-F.col("high_count"), F.col("subset")))["subset"].alias("most_spikes"),
        F.min(F.when(variable, F.struct(-F.col("variability"), F.col("subset"))))[
            "subset"
        ].alias("most_variable"),
        F.min(F.when(variable, F.struct("variability", "subset")))["subset"].alias(
            "least_variable"
        ),
    )


def spike_rows(df: DataFrame, v: str = POWER, q: float = 0.75) -> DataFrame:
    """Rows at or above the q-quantile of all rows."""
    cut = quantile_row(df, v, [q], ["_cut"])
    return attach_one_row(df, cut).where(F.col(v) >= F.col("_cut")).drop("_cut")


def spike_hours(spikes: DataFrame, n: int = 5) -> DataFrame:
    counts = spikes.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, "n", n, ["hour"])


def _grid(spikes: DataFrame, axis: str) -> DataFrame:
    """Counts for every (hour, axis value) pair that has a row or column, missing pairs as 0.

    The pair table has at most 24 hours times the number of days.
    """
    counts = spikes.groupBy("hour", axis).agg(F.count(F.lit(1)).alias("n"))
    hours = counts.select("hour").distinct()
    days = counts.select(axis).distinct()
    pairs = days.crossJoin(F.broadcast(hours))
    return pairs.join(counts, ["hour", axis], "left").fillna(0, ["n"])


def daily_spike_pivot(spikes: DataFrame) -> DataFrame:
    """Spike count per hour and date in long form."""
    return _grid(spikes, "date")


def spike_heatmap(spikes: DataFrame) -> DataFrame:
    """Spike count per hour and elapsed day in long form."""
    return _grid(spikes, "day_num")


def recurring_hours(df: DataFrame, spikes: DataFrame, share: float = 0.5) -> DataFrame:
    """Hours that have spikes on at least `share` of all dates."""
    dates = df.agg(F.count_distinct("date").alias("_dates"))
    days = spikes.groupBy("hour").agg(F.count_distinct("date").alias("n_days"))
    return (
        attach_one_row(days, dates)
        .where(F.col("n_days") >= F.col("_dates") * share)
        .select("hour", "n_days")
    )


def band_dominance(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per time band: modal cluster and mean power."""
    banded = time_bands(df)
    means = banded.groupBy("time_band").agg(F.avg(POWER).alias("mean_power"))
    return means.join(modal_value(banded, ["time_band"], cluster, "dominant_cluster"), "time_band")


def day_dominance(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per date: modal cluster and mean power."""
    means = df.groupBy("date").agg(F.avg(POWER).alias("mean_power"))
    return means.join(modal_value(df, ["date"], cluster, "dominant_cluster"), "date")


def rank_clusters(means: DataFrame, keys: list[str], cluster: str, metric: str) -> DataFrame:
    """Add the 1-based `rank` of each cluster by `metric` within its group (a few rows each)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return means.withColumn("rank", F.row_number().over(w.orderBy(metric, cluster)))
