"""Cleaning of raw readings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.functions.rules import gpu_type_of
from wattspark.schema import POWER

# The strict log format, and the formats also accepted by the lenient parser.
STRICT_FORMAT = "yyyy/MM/dd HH:mm:ss.SSSSSS"
LENIENT_FORMATS = [
    "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
]


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def trim_strings(
    df: DataFrame,
    cols: tuple[str, ...] = ("hostname", "gpu_name", "pci_bus_id"),
    null_as: str | None = None,
) -> DataFrame:
    """Trim text columns that are present; missing text stays NULL unless `null_as` is given."""
    new = {}
    for c in cols:
        if c in df.columns:
            text = F.trim(F.col(c).cast("string"))
            new[c] = text if null_as is None else F.coalesce(text, F.lit(null_as))
    return df.withColumns(new)


def _parsed(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("timestamp_ntz")


def parse_ts_strict(df: DataFrame, col: str = "timestamp", fmt: str = STRICT_FORMAT) -> DataFrame:
    """Parse one format; anything else becomes NULL."""
    return df.withColumn(col, _parsed(F.col(col), fmt))


def parse_ts_lenient(
    df: DataFrame,
    col: str = "timestamp",
    fmts: list[str] | None = None,
    fail_on_bad: bool = True,
) -> DataFrame:
    """Parse any known format; a bad non-empty value fails the query unless told otherwise."""
    text = F.col(col)
    value = F.coalesce(*[_parsed(text, f) for f in fmts or LENIENT_FORMATS])
    if fail_on_bad:
        bad = F.raise_error(F.concat(F.lit("bad timestamp: "), text)).cast("timestamp_ntz")
        value = F.when(text.isNotNull() & value.isNull(), bad).otherwise(value)
    return df.withColumn(col, value)


def drop_invalid(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in the named columns."""
    return df.dropna(subset=subset or ["timestamp", POWER])


def data_quality(raw: DataFrame, power: str = POWER, ts: str = "timestamp") -> DataFrame:
    """Row counts before and after cleaning, in one pass over parsed but unfiltered rows."""
    ts_ok = F.col(ts).isNotNull()
    power_ok = F.col(power).isNotNull() & ~F.isnan(F.col(power))
    return raw.agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(~ts_ok).alias("bad_timestamp"),
        F.count_if(ts_ok & ~power_ok).alias("bad_power"),
        F.count_if(ts_ok & power_ok).alias("rows_kept"),
    )


def gpu_id(df: DataFrame) -> DataFrame:
    return df.withColumn("gpu_id", F.concat("hostname", F.lit("_"), "pci_bus_id"))


def gpu_type(df: DataFrame, col: str = "gpu_name") -> DataFrame:
    return df.withColumn("gpu_type", gpu_type_of(F.col(col)))


def clean_telemetry(df: DataFrame) -> DataFrame:
    """Headers, text, timestamps, invalid rows and device id in one narrow plan."""
    parsed = parse_ts_strict(trim_strings(clean_headers(df)))
    return gpu_id(drop_invalid(parsed, ["timestamp", POWER]))
