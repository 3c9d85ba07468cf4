"""Interquartile fences, global and per group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row, settle, valid
from wattspark.operators.quantiles import quantiles
from wattspark.schema import GPU_KEYS, NODE_TOTAL, POWER


def fences(df: DataFrame, keys: list[str], v: str = POWER, k: float = 1.5, method: str = "exact") -> DataFrame:
    """Per group: n, q1, q3 and the two fences.

    `method="approx"` takes the quartiles from a sketch in one scan, without interpolation.
    """
    if method == "approx":
        q = df.groupBy(*keys).agg(
            F.count(v).alias("n"), F.percentile_approx(v, [0.25, 0.75], 10_000).alias("_q")
        )
        q = q.select(*keys, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    else:
        q = quantiles(df, keys, v, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return settle(
        q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)
    )


# Of the stored sketches; the rank of a quantile is within this share of all rows (99 %).
SKETCH_K, SKETCH_RANK = 400, 0.01


def value_sketches(df: DataFrame, keys: list[str], v: str = POWER, ts: str = "timestamp", piece: str = "hour") -> DataFrame:
    """Per group and time piece (`piece_start`): rows and a mergeable quantile sketch of `v`.

    Stored once and appended to as pieces close, it gives fences of any range without the readings. Rows
    without a time or a valid value are left out.
    """
    start = F.date_trunc(piece, ts).cast("timestamp_ntz").alias("piece_start")
    rows = df.where(valid(v) & F.col(ts).isNotNull())
    return rows.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def sketched_fences(sketches: DataFrame, keys: list[str], first: str | None = None, end: str | None = None, k: float = 1.5) -> DataFrame:
    """n, q1, q3 and the fences per group from the merged sketches of the pieces from `first` up to before `end`.

    Only sketches of bounded size are merged, so fences that roll forward never read old rows again.
    """
    if first:
        sketches = sketches.where(F.col("piece_start") >= F.lit(first).cast("timestamp_ntz"))
    if end:
        sketches = sketches.where(F.col("piece_start") < F.lit(end).cast("timestamp_ntz"))
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_s"))
    at = lambda q: F.kll_sketch_get_quantile_double("_s", F.lit(q))
    found = merged.select(*keys, "n", at(0.25).alias("q1"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return found.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)


def outside(df: DataFrame, bounds: DataFrame, keys: list[str], v: str = POWER) -> DataFrame:
    """Rows strictly outside their group's fences."""
    cut = bounds.select(*keys, "lower", "upper")
    joined = df.join(cut, keys) if keys else attach_one_row(df, cut)
    return joined.where((F.col(v) < F.col("lower")) | (F.col(v) > F.col("upper"))).drop(
        "lower", "upper"
    )


def iqr_outliers_global(df: DataFrame, v: str = POWER, k: float = 1.5) -> DataFrame:
    return outside(df, fences(df, [], v, k), [], v)


def iqr_outliers_grouped(
    df: DataFrame, keys: list[str], v: str = POWER, k: float = 1.5, method: str = "exact"
) -> DataFrame:
    return outside(df, fences(df, keys, v, k, method), keys, v)


def node_outliers(node: DataFrame) -> DataFrame:
    """Outliers of the node series, with a fixed marker in place of a bus id."""
    found = iqr_outliers_grouped(node, ["hostname"])
    return found.select("hostname", F.lit(NODE_TOTAL).alias("pci_bus_id"), "timestamp", POWER)


def gpu_outliers(gpu: DataFrame) -> DataFrame:
    return iqr_outliers_grouped(gpu, GPU_KEYS).select(*GPU_KEYS, "timestamp", POWER)


def subset_outliers(df: DataFrame) -> DataFrame:
    """Outliers within each day-range subset (one plan for all subsets)."""
    return iqr_outliers_grouped(df, ["subset"])


def all_outliers(node: DataFrame, gpu: DataFrame) -> DataFrame:
    return node_outliers(node).unionByName(gpu_outliers(gpu))
