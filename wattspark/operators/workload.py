"""Workload states and burstiness."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.functions.rules import usage_pattern
from wattspark.operators.common import attach_one_row
from wattspark.operators.quantiles import quantile_row
from wattspark.schema import POWER, WORKLOAD_STATES


def workload_state(df: DataFrame, v: str = POWER, q: tuple = (0.25, 0.75)) -> DataFrame:
    """Add `state`: Idle <= q25 < Moderate <= q75 < Active, over the quartiles of all rows."""
    cuts = quantile_row(df, v, list(q), ["_idle", "_active"])
    state = (
        F.when(F.col(v) <= F.col("_idle"), "Idle")
        .when(F.col(v) <= F.col("_active"), "Moderate")
        .otherwise("Active")
    )
    return attach_one_row(df, cuts).withColumn("state", state).drop("_idle", "_active")


def state_share(df: DataFrame) -> DataFrame:
    """Percentage of rows per state (three rows at most are joined with the total)."""
    counts = df.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return attach_one_row(counts, total).select(
        "state", "n", (F.col("n") / F.col("_total") * 100).alias("pct")
    )


def hourly_state_pct(df: DataFrame) -> DataFrame:
    """Percentage of each state per hour, one column per state."""
    wide = [
        (F.avg((F.col("state") == s).cast("double")) * 100).alias(f"pct_{s.lower()}")
        for s in WORKLOAD_STATES
    ]
    return df.groupBy("hour").agg(*wide)


def hourly_cv(df: DataFrame, v: str = POWER) -> DataFrame:
    """Coefficient of variation per hour; 0 when the mean is not positive, NULL for one row."""
    cv = F.when(F.avg(v) > 0, F.stddev_samp(v) / F.avg(v)).otherwise(F.lit(0.0))
    return df.groupBy("hour").agg(cv.alias("cv"))


def bursty_hours(df: DataFrame, v: str = POWER) -> DataFrame:
    """Hours above the median coefficient are bursty, the others balanced; NULL is in neither."""
    cv = hourly_cv(df, v)
    mid = cv.agg(F.median("cv").alias("_mid"))
    return (
        attach_one_row(cv, mid)
        .where(F.col("cv").isNotNull())
        .select(
            "hour",
            "cv",
            F.when(F.col("cv") > F.col("_mid"), "bursty").otherwise("balanced").alias("kind"),
        )
    )


def overall_cv(df: DataFrame, v: str = POWER) -> DataFrame:
    return df.agg((F.stddev_samp(v) / F.avg(v)).alias("cv"))


def overall_pattern(df: DataFrame, v: str = POWER, cut: float = 0.5) -> DataFrame:
    return overall_cv(df, v).withColumn("pattern", usage_pattern(F.col("cv"), cut))


def host_state_ratio(df: DataFrame) -> DataFrame:
    def share(state: str):
        return F.avg((F.col("state") == state).cast("double")) * 100

    return df.groupBy("hostname").agg(
        share("Idle").alias("idle_pct"), share("Active").alias("active_pct")
    )
