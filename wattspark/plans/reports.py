"""Result tables written out, and reports as data."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.functions import rules
from wattspark.functions.timefeat import time_bands
from wattspark.operators.behavior import cluster_census, top_outlier_gpus, top_outlier_hours
from wattspark.operators.common import attach_one_row, settle
from wattspark.operators.peaks import inlier_density, peak_hours
from wattspark.operators.quantiles import quantile_row
from wattspark.operators.stats import high_load_gpus, load_by_gpu_type, load_by_node
from wattspark.schema import ALL_LABELS, POWER, share_column


def write_tables(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
) -> None:
    """Write a result table; every task writes its own files."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.format(fmt).save(path)


def fixed(c: Column, digits: int = 4) -> Column:
    """A number as text with a fixed number of decimals."""
    scale = 10**digits
    return (F.floor(c * scale + 0.5000001) / scale).cast(f"decimal(24,{digits})").cast("string")


def number(c: Column, digits: int = 4) -> Column:
    """A number with a fixed number of decimals."""
    return F.floor(c * 10**digits + 0.5000001) / 10**digits


def _listed(df: DataFrame, name: str, key: str, value: str, order: Column) -> DataFrame:
    """A small result as one array of {key, value}, in a given order."""
    entry = F.struct(order.alias("o"), F.col(key).alias("key"), F.col(value).alias("value"))
    return df.agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["value"])
        ).alias(name)
    )


def report_json(
    df: DataFrame, epsilon: float, min_samples: int = 20, top_gpus: int = 5, top_hours: int = 3
) -> DataFrame:
    """One row with the structured report as JSON text.

    Every part is an aggregate of bounded size: 24 hours, a top-k, hosts, device types.
    """
    up = lambda c: F.col(c)
    down = lambda c: -F.col(c)
    value = number(F.col("avg_power"))
    hours = peak_hours(df).agg(F.array_sort(F.collect_list("hour")).alias("peak_hours"))
    parts = [
        hours,
        inlier_density(df).select(
            number(F.col("peak")).alias("density_peak"),
            number(F.col("non_peak")).alias("density_non_peak"),
        ),
        cluster_census(df).select(
            "n_clusters", "n_outliers", number(F.col("outlier_pct")).alias("outlier_pct")
        ),
        _listed(top_outlier_gpus(df, top_gpus), "top_outlier_gpus", "gpu_id", "n", down("n")),
        _listed(top_outlier_hours(df, top_hours), "top_outlier_hours", "hour", "n", down("n")),
        _listed(load_by_node(df).withColumn("v", value), "load_by_node", "hostname", "v", up("hostname")),
        _listed(load_by_gpu_type(df).withColumn("v", value), "load_by_gpu_type", "gpu_type", "v", up("gpu_type")),
        _listed(high_load_gpus(df, 5).withColumn("v", value), "high_load_gpus", "gpu_id", "v", down("avg_power")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))
    report = F.struct(
        F.struct(
            number(F.lit(float(epsilon))).alias("epsilon"), F.lit(min_samples).alias("min_samples")
        ).alias("parameters"),
        F.struct("peak_hours", "density_peak", "density_non_peak").alias("key_insights"),
        F.struct(
            "n_clusters", "n_outliers", "outlier_pct", "top_outlier_gpus", "top_outlier_hours"
        ).alias("outlier_findings"),
        F.struct("load_by_node", "load_by_gpu_type", "high_load_gpus").alias("workload"),
    )
    return row.select(F.to_json(report).alias("report"))


# What the summary reports look at: the grouping sets of one scan.
FACTS = {
    "total": [],
    "hour": ["hour"],
    "host": ["hostname"],
    "type": ["gpu_type"],
    "device": ["gpu_id"],
    "cluster": ["cluster"],
    "outlier": ["outlier_type"],
    "peak_label": ["is_peak", "behavior_label"],
    "device_label": ["gpu_id", "behavior_label"],
}


def report_facts(df: DataFrame) -> DataFrame:
    """Every aggregate the summary reports need of a labelled table, from one scan, stored.

    One row per group of each grouping set: `fact` (its name), the group's columns (others NULL), rows,
    noise rows, mean and sample variance of power. At most devices x labels rows.
    """
    measures = [F.count_if(F.col("cluster") == -1).alias("noise"), F.var_samp(POWER).alias("variance")]
    return _grouped(df, FACTS, measures)


def _grouped(df: DataFrame, facts: dict[str, list[str]], measures: list[Column]) -> DataFrame:
    """`fact`, the groups' columns, rows, mean power and the measures of all grouping sets, stored."""
    columns = list(dict.fromkeys(c for group in facts.values() for c in group))
    name = F.lit(None)
    for fact, group in facts.items():
        # Bit of a column, the first one highest: set where the column is not part of the group.
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in group)
        name = F.when(F.col("_set") == bits, fact).otherwise(name)
    sets = [[F.col(c) for c in group] for group in facts.values()]
    counted = [F.count(F.lit(1)).alias("n"), F.avg(POWER).alias("mean"), *measures]
    made = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_set"), *counted)
    return settle(made.withColumn("fact", name).drop("_set"))


def _fact(facts: DataFrame, name: str) -> DataFrame:
    return facts.where(F.col("fact") == name)


def _device_classes(facts: DataFrame, with_extreme: bool) -> DataFrame:
    part = lambda x: F.sum(F.when(F.col("behavior_label") == x, F.col("n")).otherwise(0)) / F.sum("n") * 100
    shares = _fact(facts, "device_label").groupBy("gpu_id").agg(*[part(x).alias(share_column(x)) for x in ALL_LABELS])
    return shares.select("gpu_id", rules.gpu_class_rule(with_extreme=with_extreme).alias("class"))


def _clusters(facts: DataFrame, label) -> DataFrame:
    found = _fact(facts, "cluster").where("cluster <> -1")
    return found.withColumn("label", F.concat_ws(" ", F.col("cluster").cast("string"), label(F.col("mean"), F.col("variance"))))


def _joined(*values: Column) -> Column:
    return F.concat_ws(" ", *values)


def _first_of_class(classes: DataFrame, name: str, n: int = 5) -> DataFrame:
    return classes.where(F.col("class") == name).orderBy("gpu_id").limit(n)


def _hosts(facts: DataFrame) -> DataFrame:
    """One row: the most and the least loaded host."""
    by = _fact(facts, "host")
    return by.agg(
        F.min_by(F.struct("hostname", "mean"), F.struct(-F.col("mean"), F.col("hostname"))).alias("top"),
        F.min_by(F.struct("hostname", "mean"), F.struct(F.col("mean"), F.col("hostname"))).alias("low"),
    )


_CLASSES = ["Stable", "High-Load Consistent", "Unstable / Spiky"]


def deep_report(facts: DataFrame, epsilon: float) -> DataFrame:
    """The report of the radius search: clusters, outlier types, device classes and loads (section, key, value)."""
    classes = _device_classes(facts, with_extreme=False)
    counted = classes.agg(*[F.count_if(F.col("class") == c).alias(f"_{i}") for i, c in enumerate(_CLASSES)])
    per_class = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_{i}").alias("n")) for i, c in enumerate(_CLASSES)])))
    hosts = _hosts(facts)
    text = lambda c: F.col(c).cast("string")
    return report_rows(
        {
            "parameters": (_fact(facts, "total"), F.lit("epsilon"), fixed(F.lit(float(epsilon)))),
            "cluster_interpretation": (_clusters(facts, rules.behavior_v2), F.col("label"), _joined(fixed(F.col("mean")), fixed(F.col("variance")), text("n"))),
            "outlier_types": (_fact(facts, "outlier").where("outlier_type IS NOT NULL"), F.col("outlier_type"), text("n")),
            "gpu_classes": (per_class, F.col("class"), text("n")),
            "unstable_gpus": (_first_of_class(classes, "Unstable / Spiky"), F.col("gpu_id"), F.col("class")),
            "load_by_gpu_type": (_fact(facts, "type"), F.col("gpu_type"), fixed(F.col("mean"))),
            "top_node": (hosts, F.col("top.hostname"), fixed(F.col("top.mean"))),
            "least_node": (hosts, F.col("low.hostname"), fixed(F.col("low.mean"))),
        }
    )


def final_report(facts: DataFrame, epsilon: float, hours: int = 3) -> DataFrame:
    """The report of the final run (section, key, value)."""
    classes = _device_classes(facts, with_extreme=True)
    total, hosts = _fact(facts, "total"), _hosts(facts)
    clusters = _clusters(facts, rules.behavior_final)
    shared = attach_one_row(clusters, total.select(F.col("n").alias("_all")))
    # Everything that is not a spike, in percent of the rows of the peak flag.
    calm = F.sum(F.when(F.col("behavior_label") == "Spike Event", 0).otherwise(F.col("n")))
    peak = _fact(facts, "peak_label").groupBy("is_peak").agg((calm / F.sum("n") * 100).alias("pct"))
    worst = _fact(facts, "hour").where("noise > 0").orderBy(F.desc("noise"), "hour").limit(hours)
    return report_rows(
        {
            "parameters": (total, F.lit("epsilon"), fixed(F.lit(float(epsilon)))),
            "clusters": (clusters.agg(F.count(F.lit(1)).alias("k")), F.lit("n_clusters"), F.col("k").cast("string")),
            "noise_pct": (total, F.lit("outlier_pct"), fixed(F.col("noise") / F.col("n") * 100)),
            "inliers_pct": (peak, F.when(F.col("is_peak") == 1, "Peak").otherwise("Non-Peak"), fixed(F.col("pct"))),
            "cluster_interpretation": (shared, F.col("label"), _joined(fixed(F.col("mean")), fixed(F.col("n") / F.col("_all") * 100))),
            "outlier_hours": (worst, F.col("hour"), F.col("noise").cast("string")),
            "load_by_gpu_type": (_fact(facts, "type"), F.col("gpu_type"), fixed(F.col("mean"))),
            "high_load_gpus": (_first_of_class(classes, "High-Load Consistent"), F.col("gpu_id"), F.col("class")),
            "investigate": (_first_of_class(classes, "Unstable / Spiky"), F.col("gpu_id"), F.col("class")),
            "balance_from": (hosts, F.col("top.hostname"), fixed(F.col("top.mean"))),
            "balance_to": (hosts, F.col("low.hostname"), fixed(F.col("low.mean"))),
        }
    )


def final_report_json(facts: DataFrame, epsilon: float) -> DataFrame:
    """One row with the JSON form of the final run; its advice is given as devices and hosts, not as sentences."""
    total = _fact(facts, "total").select(number(F.col("noise") / F.col("n") * 100).alias("outlier_pct"))
    clusters = _clusters(facts, rules.behavior_final).agg(F.count(F.lit(1)).alias("full_clusters"))
    unstable = _first_of_class(_device_classes(facts, with_extreme=True), "Unstable / Spiky")
    listed = unstable.agg(F.array_sort(F.collect_list("gpu_id")).alias("inspect"))  # at most five
    hosts = _hosts(facts).select(F.col("top.hostname").alias("from"), F.col("low.hostname").alias("to"))
    row = attach_one_row(attach_one_row(attach_one_row(total, clusters), listed), hosts)
    report = F.struct(
        number(F.lit(float(epsilon))).alias("clustering_radius"),
        F.struct("full_clusters", "outlier_pct").alias("clustering_performance"),
        F.struct("inspect", F.struct("from", "to").alias("balance")).alias("actionable_insights"),
    )
    return row.select(F.to_json(report).alias("report"))


# The grouping sets of the pattern and workload report.
PATTERN_FACTS = {
    "total": [],
    "hour": ["hour"],
    "hour_date": ["hour", "date"],
    "band_cluster": ["time_band", "cluster"],
    "date_cluster": ["date", "cluster"],
    "state": ["state"],
    "host_state": ["hostname", "state"],
}


def _dominant(facts: DataFrame, name: str, key: str) -> DataFrame:
    """Per `key`: the most frequent cluster (of equally frequent ones, the smallest) and the mean power."""
    return _fact(facts, name).groupBy(key).agg(
        F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("dominant"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
    )


def pattern_report(df: DataFrame, spike: float = 0.75, idle: float = 0.25, recurring: float = 0.5, cut: float = 0.5) -> DataFrame:
    """Repeating patterns and workload of a clustered series with hour and date (section, key, value).

    One pass finds the quartiles, one with grouping sets makes all numbers.
    """
    marked = attach_one_row(time_bands(df), quantile_row(df, POWER, [idle, spike], ["_idle", "_spike"]))
    state = F.when(F.col(POWER) <= F.col("_idle"), "Idle").when(F.col(POWER) <= F.col("_spike"), "Moderate").otherwise("Active")
    measures = [F.count_if(F.col(POWER) >= F.col("_spike")).alias("spikes"), F.stddev_samp(POWER).alias("deviation")]
    facts = _grouped(marked.withColumn("state", state), PATTERN_FACTS, measures)
    total = _fact(facts, "total")
    hours = _fact(facts, "hour").where("hour IS NOT NULL")
    dates = _fact(facts, "date_cluster").agg(F.count_distinct("date").alias("_dates"))
    days = _fact(facts, "hour_date").where("spikes > 0").groupBy("hour").agg(F.count(F.lit(1)).alias("days"))
    again = attach_one_row(days, dates).where(F.col("days") >= F.col("_dates") * recurring)
    share = attach_one_row(_fact(facts, "state"), total.select(F.col("n").alias("_all")))
    cv = hours.select("hour", F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(0.0).alias("cv"))
    kinds = attach_one_row(cv, cv.agg(F.median("cv").alias("_mid"))).where("cv IS NOT NULL")  # 24 hours
    part = lambda x: fixed(F.sum(F.when(F.col("state") == x, F.col("n")).otherwise(0)) / F.sum("n") * 100)
    hosts = _fact(facts, "host_state").groupBy("hostname").agg(_joined(part("Idle"), part("Active")).alias("shares"))
    overall = total.select((F.col("deviation") / F.col("mean")).alias("cv"))
    text = lambda c: F.col(c).cast("string")
    found = _joined(text("dominant"), fixed(F.col("mean")))
    return report_rows(
        {
            "spike_hours": (hours.where("spikes > 0").orderBy(F.desc("spikes"), "hour").limit(5), F.col("hour"), text("spikes")),
            "recurring_hours": (again, F.col("hour"), text("days")),
            "band_dominance": (_dominant(facts, "band_cluster", "time_band"), F.col("time_band"), found),
            "day_dominance": (_dominant(facts, "date_cluster", "date"), F.col("date"), found),
            "state_share": (share, F.col("state"), fixed(F.col("n") / F.col("_all") * 100)),
            "burstiness": (kinds, F.col("hour"), F.when(F.col("cv") > F.col("_mid"), "bursty").otherwise("balanced")),
            "overall": (overall, rules.usage_pattern(F.col("cv"), cut), fixed(F.col("cv"))),
            "host_states": (hosts, F.col("hostname"), F.col("shares")),
        }
    )


def report_section(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), key.cast("string").alias("key"), value.alias("value")
    )


def report_rows(tables: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Text reports as a long table: section, key, value. Inputs are small result tables."""
    out = None
    for section, (df, key, value) in tables.items():
        part = report_section(df, section, key, value)
        out = part if out is None else out.unionByName(part)
    return out


def analysis_report(df: DataFrame) -> DataFrame:
    """The sections of the text report for a clustered, labelled table."""
    watts = fixed(F.col("avg_power"))
    census = cluster_census(df)
    return report_rows(
        {
            "clusters": (census, F.lit("n_clusters"), F.col("n_clusters").cast("string")),
            "noise_pct": (census, F.lit("outlier_pct"), fixed(F.col("outlier_pct"))),
            "peak_hours": (peak_hours(df), F.col("hour"), watts),
            "top_outlier_gpus": (top_outlier_gpus(df), F.col("gpu_id"), F.col("n").cast("string")),
            "top_outlier_hours": (top_outlier_hours(df), F.col("hour"), F.col("n").cast("string")),
            "load_by_node": (load_by_node(df), F.col("hostname"), watts),
            "load_by_gpu_type": (load_by_gpu_type(df), F.col("gpu_type"), watts),
            "high_load_gpus": (high_load_gpus(df), F.col("gpu_id"), watts),
        }
    )
