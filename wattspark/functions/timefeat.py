"""Time columns: calendar fields, elapsed days, buckets, bands and day-range subsets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, day of month, day of week (Monday = 0)."""
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day": F.dayofmonth(ts),
            "day_of_week": F.weekday(ts),
        }
    )


def calendar_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """English day name, date, and the date as text."""
    return df.withColumns(
        {
            "day_name": F.date_format(ts, "EEEE"),
            "date": F.to_date(ts),
            "date_text": F.date_format(ts, "yyyy-MM-dd"),
        }
    )


def day_number(df: DataFrame, ts: str = "timestamp", label: bool = False) -> DataFrame:
    """Elapsed 24-hour periods since the first reading, plus one (not calendar days)."""
    first = df.agg(F.min(ts).alias("_first"))
    out = attach_one_row(df, first).withColumn(
        "day_num",
        (F.extract(F.lit("DAY"), F.col(ts) - F.col("_first")) + 1).cast("int"),
    )
    if label:
        out = out.withColumn("day_label", F.concat(F.lit("Day "), F.col("day_num")))
    return out.drop("_first")


def floor_5min(df: DataFrame, width: str = "5 minutes", ts: str = "timestamp") -> DataFrame:
    """Add `bucket`, the start of the fixed-width interval that holds the reading."""
    return df.withColumn("bucket", F.window(ts, width)["start"])


def day_range_subset(df: DataFrame, width: int = 3, day: str = "day_num") -> DataFrame:
    """Add `subset`: consecutive ranges of `width` elapsed days, subset_1 for the first. All days belong
    to a range; only rows without a day are dropped."""
    number = F.floor((F.col(day) - 1) / width) + 1
    return df.withColumn("subset", F.concat(F.lit("subset_"), number.cast("string"))).where(F.col("subset").isNotNull())


def time_band_of(hour: Column) -> Column:
    return (
        F.when(hour < 6, "Night (0-6)")
        .when(hour < 12, "Morning (6-12)")
        .when(hour < 18, "Afternoon (12-18)")
        .otherwise("Evening (18-24)")
    )


def time_bands(df: DataFrame, hour: str = "hour") -> DataFrame:
    return df.withColumn("time_band", time_band_of(F.col(hour)))


def daypart_of(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 18), "Daytime")
        .when((hour >= 18) & (hour < 22), "Evening")
        .otherwise("Night/Early Morning")
    )


def daypart_label(df: DataFrame, hour: str = "hour") -> DataFrame:
    return df.withColumn("daypart", daypart_of(F.col(hour)))
