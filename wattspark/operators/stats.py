"""Grouped statistics, box-plot tables, histograms and binned chart data."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.functions.timefeat import day_number
from wattspark.operators.common import attach_one_row, settle, valid
from wattspark.operators.quantiles import quantile_row, quantiles
from wattspark.schema import GPU_KEYS, NODE_TOTAL, POWER

# Cumulative probabilities of Poisson(1), in 65536ths: a draw of 16 bits weighs as many as it reaches.
POISSON = [round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(7)]


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(POWER).alias("mean"),
        F.var_samp(POWER).alias("variance"),
        F.stddev_samp(POWER).alias("std_dev"),
    )


def node_stats(node: DataFrame) -> DataFrame:
    return _moments(node, ["hostname"]).select(
        "hostname", F.lit(NODE_TOTAL).alias("pci_bus_id"), "mean", "variance", "std_dev"
    )


def gpu_stats(gpu: DataFrame) -> DataFrame:
    return _moments(gpu, GPU_KEYS)


def union_stats(node: DataFrame, gpu: DataFrame) -> DataFrame:
    cols = [*GPU_KEYS, "mean", "variance", "std_dev"]
    return node_stats(node).unionByName(gpu_stats(gpu)).select(*cols)


def subset_metrics(df: DataFrame, outliers: DataFrame) -> DataFrame:
    """Per subset: mean, sample variance and number of outliers (0 when there are none)."""
    base = df.groupBy("subset").agg(
        F.avg(POWER).alias("mean_power"), F.var_samp(POWER).alias("variance")
    )
    spikes = outliers.groupBy("subset").agg(F.count(F.lit(1)).alias("spikes"))
    return base.join(spikes, "subset", "left").fillna(0, ["spikes"])


def subset_compare(metrics: DataFrame) -> DataFrame:
    """Names of the subsets with most variance, most outliers, least variance (ties: first)."""
    first_max = lambda c: F.min(F.struct(-F.col(c), F.col("subset")))["subset"]
    first_min = F.min(
        F.when(F.col("variance").isNotNull(), F.struct("variance", "subset"))
    )["subset"]
    known = metrics.withColumn("_v", F.coalesce(F.col("variance"), F.lit(float("-inf"))))
    return known.agg(
        first_max("_v").alias("highest_variance"),
        first_max("spikes").alias("most_spikes"),
        first_min.alias("most_stable"),
    )


def load_by_node(df: DataFrame) -> DataFrame:
    return df.groupBy("hostname").agg(F.avg(POWER).alias("avg_power"))


def load_by_gpu_type(df: DataFrame) -> DataFrame:
    return df.groupBy("gpu_type").agg(F.avg(POWER).alias("avg_power"))


def node_extremes(df: DataFrame) -> DataFrame:
    """Most and least loaded node with their means."""
    loads = load_by_node(df)
    top = F.min(F.struct((-F.col("avg_power")).alias("p"), F.col("hostname")))
    low = F.min(F.struct(F.col("avg_power").alias("p"), F.col("hostname")))
    return loads.agg(top.alias("t"), low.alias("l")).select(
        F.col("t.hostname").alias("top_node"),
        (-F.col("t.p")).alias("top_power"),
        F.col("l.hostname").alias("low_node"),
        F.col("l.p").alias("low_power"),
    )


def top_k(df: DataFrame, metric: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows with the largest metric; `ties` makes the order total."""
    return df.orderBy(F.desc(metric), *ties).limit(n)


def high_load_gpus(df: DataFrame, n: int = 5) -> DataFrame:
    loads = df.groupBy("gpu_id").agg(F.avg(POWER).alias("avg_power"))
    return top_k(loads, "avg_power", n, ["gpu_id"])


def box_stats(df: DataFrame, keys: list[str], v: str = POWER, k: float = 1.5) -> DataFrame:
    """Box plot as numbers: quartiles, whisker ends, mean, rows and rows outside the fences.

    A whisker ends at the most extreme value that is still inside the fences.
    """
    q = quantiles(df, keys, v, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = settle(q.withColumn("_lo", F.col("q1") - k * iqr).withColumn("_hi", F.col("q3") + k * iqr))
    value = F.col(v)
    inside = (value >= F.col("_lo")) & (value <= F.col("_hi"))
    spread = df.select(*keys, v).join(q.select(*keys, "_lo", "_hi"), keys)
    ends = spread.groupBy(*keys).agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.avg(v).alias("mean"),
        F.count_if(~inside).alias("n_fliers"),
    )
    return ends.join(q.drop("_lo", "_hi"), keys).select(
        *keys, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "mean", "n_fliers"
    )


def box_stats_node(node: DataFrame) -> DataFrame:
    return box_stats(node, ["hostname"])


def box_stats_gpu(gpu: DataFrame) -> DataFrame:
    return box_stats(gpu, GPU_KEYS)


def _with_day(df: DataFrame, use_day_numbers: bool) -> DataFrame:
    if use_day_numbers:
        return day_number(df, label=True).withColumnRenamed("day_label", "day_key")
    return df.withColumn("day_key", F.date_format("timestamp", "yyyy-MM-dd"))


def box_stats_daily(df: DataFrame, use_day_numbers: bool = True) -> DataFrame:
    return box_stats(_with_day(df, use_day_numbers), ["day_key"])


def box_stats_node_daily(df: DataFrame, use_day_numbers: bool = True) -> DataFrame:
    return box_stats(_with_day(df, use_day_numbers), ["hostname", "day_key"])


def box_stats_peak(df: DataFrame) -> DataFrame:
    return box_stats(df, ["is_peak", "hostname"])


def box_stats_gpu_id(df: DataFrame) -> DataFrame:
    return box_stats(df, ["gpu_id"])


def _bin_of(v: str, bins: int):
    """Equal-width bin over [_mn, _mx]; the last bin is closed, a single value is in bin 0."""
    span = F.col("_mx") - F.col("_mn")
    pos = F.when(span > 0, (F.col(v) - F.col("_mn")) / span * bins).otherwise(F.lit(0.0))
    return F.least(F.lit(bins - 1), F.floor(pos).cast("int"))


def power_histogram(df: DataFrame, v: str = POWER, bins: int = 80) -> DataFrame:
    """Counts in equal-width bins, with the idle and active thresholds of the chart."""
    ends = df.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    marks = quantile_row(df, v, [0.25, 0.75], ["idle_threshold", "active_threshold"])
    counts = (
        attach_one_row(df.select(v), ends)
        .groupBy(_bin_of(v, bins).alias("bin"), "_mn", "_mx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_mx") - F.col("_mn")) / bins
    return attach_one_row(counts, marks).select(
        "bin",
        (F.col("_mn") + F.col("bin") * width).alias("bin_start"),
        (F.col("_mn") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
        "idle_threshold",
        "active_threshold",
    )


def host_type_quartiles(df: DataFrame, v: str = POWER, bins: int = 20) -> DataFrame:
    """Violin plot as numbers: quartiles and binned density per (host, device type)."""
    keys = ["hostname", "gpu_type"]
    q = quantiles(df, keys, v, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    ends = settle(df.groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx")))
    density = (
        df.select(*keys, v)
        .join(ends, keys)
        .groupBy(*keys, _bin_of(v, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("bin_rows"))
    )
    return density.join(settle(q), keys).select(
        *keys,
        "bin",
        "bin_rows",
        (F.col("bin_rows") / F.col("n")).alias("share"),
        "q1",
        "median",
        "q3",
    )


def host_type_density(df: DataFrame, v: str = POWER, bins: int = 256, points: int = 100) -> DataFrame:
    """Outline of the violin plot: a Gaussian kernel density per (host, device type) at `points` places.

    The rows are counted once into `bins` equal bins of their group (a partial aggregation); each bin's
    rows stand at their mean. The sum over the kernels then runs over at most `bins` x `points` pairs a
    group, whatever its rows. Bandwidth: sample deviation x n^(-1/5). The places reach from two
    bandwidths below the smallest value to two above the largest.

    Null and NaN values are left out. A group with one value alone, or without spread, has no density.
    """
    keys = ["hostname", "gpu_type"]
    rows = df.where(valid(v)).select(*keys, F.col(v).cast("double").alias(v))
    # One row per group, stored, so that Spark knows its size.
    shape = settle(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("_mn"), F.max(v).alias("_mx"), F.stddev_samp(v).alias("_sd")
        ).where("_mx > _mn").withColumn("bandwidth", F.expr("_sd * power(n, -0.2D)"))
    )
    counted = (
        rows.join(shape.select(*keys, "_mn", "_mx"), keys)
        .groupBy(*keys, _bin_of(v, bins).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.avg(v).alias("_at"))
    )
    low, high = "_mn - 2 * bandwidth", "_mx + 2 * bandwidth"
    places = shape.select(
        *keys, "n", "bandwidth", F.expr(f"explode(sequence(0, {points - 1}))").alias("point"), F.expr(low).alias("_lo"), F.expr(high).alias("_hi")
    ).withColumn("power", F.expr(f"_lo + (_hi - _lo) * point / {points - 1}"))
    z = (F.col("power") - F.col("_at")) / F.col("bandwidth")
    kernel = F.col("_rows") * F.exp(-0.5 * z * z)
    return (
        counted.join(places, keys)
        .groupBy(*keys, "point", "power", "n", "bandwidth")
        .agg(F.sum(kernel).alias("_sum"))
        .select(*keys, "point", "power", (F.col("_sum") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))
    )


def timeline_band(df: DataFrame, width: str = "1 hour", replicates: int = 100, level: float = 0.95) -> DataFrame:
    """Mean power per host and interval with its bootstrap band, from one aggregation.

    Every row has a Poisson(1) weight in each replicate, drawn from the MD5 digest of its `row_id` and
    the replicate's number, so the band does not depend on row order or partitioning. All replicates are
    summed side by side in one partial aggregation: one shuffle of intervals, however many rows. The band
    is the (1 - level) / 2 and (1 + level) / 2 quantile of the replicates' means, interpolated.

    Null and NaN powers are left out. A replicate whose weights are all zero has no mean and is left out
    of its interval's band.
    """
    bucket = F.window("timestamp", width)["start"].alias("bucket")
    rows = df.where(valid(POWER)).select("hostname", bucket, "row_id", POWER)
    # Eight draws of 16 bits a digest.
    digests = -(-replicates // 8)
    for i in range(digests):
        rows = rows.withColumn(f"_h{i}", F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(i)).cast("binary")))
    # The draw's place among the cumulative probabilities of Poisson(1).
    weights = []
    for r in range(replicates):
        draw = f"cast(conv(substr(_h{r // 8}, {4 * (r % 8) + 1}, 4), 16, 10) AS int)"
        weights.append(F.expr(" + ".join(f"cast({draw} >= {c} AS int)" for c in POISSON)).alias(f"_w{r}"))
    drawn = rows.select("hostname", "bucket", POWER, *weights)
    sums = [x for r in range(replicates) for x in (F.sum(f"_w{r}").alias(f"_n{r}"), F.sum(F.col(POWER) * F.col(f"_w{r}")).alias(f"_s{r}"))]
    summed = drawn.groupBy("hostname", "bucket").agg(F.avg(POWER).alias("avg_power"), F.count(F.lit(1)).alias("n"), *sums)
    means = F.array(*(F.when(F.col(f"_n{r}") > 0, F.col(f"_s{r}") / F.col(f"_n{r}")) for r in range(replicates)))
    found = summed.select("hostname", "bucket", "avg_power", "n", F.array_sort(F.filter(means, lambda m: m.isNotNull())).alias("_m"))

    def at(q: float):
        return F.expr(
            f"CASE WHEN size(_m) > 0 THEN _m[int(floor({q!r}D * (size(_m) - 1)))] + ({q!r}D * (size(_m) - 1) - floor({q!r}D * (size(_m) - 1)))"
            f" * (_m[int(ceil({q!r}D * (size(_m) - 1)))] - _m[int(floor({q!r}D * (size(_m) - 1)))]) END"
        )

    return found.select("hostname", "bucket", "avg_power", "n", at((1 - level) / 2).alias("band_low"), at((1 + level) / 2).alias("band_high"))


def timeline_sampled(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mean power per host and interval, over all rows (an aggregate needs no sample to be drawn)."""
    bucket = F.window("timestamp", width)["start"].alias("bucket")
    return (
        df.groupBy("hostname", bucket)
        .agg(F.avg(POWER).alias("avg_power"), F.count(F.lit(1)).alias("n"))
    )


def cluster_scatter(df: DataFrame, cluster: str = "cluster", step: float = 10.0) -> DataFrame:
    """Point cloud hour x power by cluster as binned counts."""
    return df.groupBy(
        cluster, "hour", F.floor(F.col(POWER) / step).cast("int").alias("power_bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def behavior_scatter(df: DataFrame, step: float = 20.0) -> DataFrame:
    """Power x rolling mean by label as binned counts over all rows."""
    return (
        df.groupBy(
            "behavior_label",
            F.floor(F.col(POWER) / step).cast("int").alias("power_bin"),
            F.floor(F.col("rolling_mean_power") / step).cast("int").alias("rolling_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sort_chrono(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Global order by range partitioning; use only where the output itself must be ordered."""
    return df.orderBy(*(by or ["timestamp", "row_id"]))
