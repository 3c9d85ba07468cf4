"""Peak hours and peak subsets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.functions.timefeat import time_features
from wattspark.operators.clean import gpu_id, gpu_type
from wattspark.operators.common import attach_one_row
from wattspark.operators.features import power_features
from wattspark.operators.quantiles import quantile_row
from wattspark.schema import POWER


def filter_host(df: DataFrame, host: str, bus: str | None = None) -> DataFrame:
    """One host's (or one device's) series in time order; the filter reaches the scan."""
    out = df.where(F.col("hostname") == host)
    if bus is not None:
        out = out.where(F.col("pci_bus_id") == bus)
    return out.orderBy("timestamp")


def hourly_avg(df: DataFrame, v: str = POWER) -> DataFrame:
    return df.groupBy("hour").agg(F.avg(v).alias("avg_power"))


def peak_hours(df: DataFrame, v: str = POWER, q: float = 0.7) -> DataFrame:
    """Hours whose mean reaches the q-quantile of the (at most 24) hourly means."""
    hours = hourly_avg(df, v)
    cut = hours.agg(F.percentile("avg_power", q).alias("_cut"))
    return attach_one_row(hours, cut).where(F.col("avg_power") >= F.col("_cut")).drop("_cut")


def is_peak(df: DataFrame, hours: DataFrame) -> DataFrame:
    """Add 0/1 `is_peak` from a table of peak hours (at most 24 rows)."""
    flag = hours.select("hour", F.lit(1).alias("is_peak"))
    return df.join(F.broadcast(flag), "hour", "left").fillna(0, ["is_peak"])


def split_peak(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("is_peak") == 1), df.where(F.col("is_peak") == 0)


def peak_by_quantile(df: DataFrame, v: str = POWER, q: float = 0.8) -> DataFrame:
    cut = quantile_row(df, v, [q], ["_cut"])
    return attach_one_row(df, cut).where(F.col(v) >= F.col("_cut")).drop("_cut")


def peak_by_hours(df: DataFrame, lo: int = 18, hi: int = 23) -> DataFrame:
    return df.where(F.col("hour").between(lo, hi))


def peak_choice(
    df: DataFrame, v: str = POWER, q: float = 0.8, lo: int = 18, hi: int = 23
) -> DataFrame:
    """Rows of the larger of the two peak definitions (a tie goes to the quantile), labelled."""
    cut = quantile_row(df, v, [q], ["_cut"])
    by_value = F.col(v) >= F.col("_cut")
    by_hour = F.col("hour").between(lo, hi)
    sizes = attach_one_row(df, cut).agg(
        F.count_if(by_value).alias("_a"), F.count_if(by_hour).alias("_b")
    )
    value_wins = F.col("_a") >= F.col("_b")
    label = F.when(value_wins, f"peak_top{round((1 - q) * 100)}pct").otherwise(f"peak_{lo}h_{hi}h")
    return (
        attach_one_row(attach_one_row(df, cut), sizes)
        .where(F.when(value_wins, by_value).otherwise(by_hour))
        .withColumn("peak_label", label)
        .drop("_cut", "_a", "_b")
    )


def inlier_density(df: DataFrame) -> DataFrame:
    """Share of non-noise rows for peak and non-peak rows; 0 when a side is empty."""
    noise_free = (F.col("cluster") != -1).cast("double")
    return df.agg(
        F.coalesce(F.avg(F.when(F.col("is_peak") == 1, noise_free)), F.lit(0.0)).alias("peak"),
        F.coalesce(F.avg(F.when(F.col("is_peak") == 0, noise_free)), F.lit(0.0)).alias("non_peak"),
    )


def telemetry_features(df: DataFrame, q: float = 0.7) -> DataFrame:
    """All feature columns of a cleaned reading table."""
    timed = time_features(gpu_type(gpu_id(df)))
    return is_peak(power_features(timed), peak_hours(timed, q=q))
