"""Sources, cleaning, columns, statistics, joins and aggregations."""

from pyspark.sql import functions as F

from checks.base import add, clu, lab, node, red, redt, spk, states, stored, sublab, subs, subout, tel, telf, redc
from wattspark.functions import rules, timefeat
from wattspark.operators import behavior, clean, downsample, features, outliers, patterns, peaks, stats, workload
from wattspark.operators.common import scratch_path, settle
from wattspark.operators.scaling import sample_n
from wattspark.plans import reports
from wattspark.schema import ALL_LABELS, GPU_KEYS, RAW, share_column
from wattspark.sources import readers
from wattspark.streaming import jobs

TEL = "row_id"


def dirty(spark, sf):
    """The readings as they might arrive: padded text, slash dates, some bad timestamps."""
    return tel(spark, sf).select(
        "row_id",
        F.concat(F.lit(" "), "hostname", F.lit(" ")).alias(" hostname"),
        F.concat("gpu_name", F.lit("  ")).alias("gpu_name "),
        F.concat(F.lit(" "), "pci_bus_id").alias(" pci_bus_id"),
        F.when(F.col("row_id") % 97 == 0, "bad")
        .otherwise(F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss.SSSSSS"))
        .alias(" timestamp"),
        F.when(F.col("row_id") % 89 == 0, None).otherwise(F.col("power_watts")).alias("power_watts"),
    )


DIRTY = """SELECT row_id, hostname, gpu_name, pci_bus_id,
    CASE WHEN row_id % 97 = 0 THEN NULL ELSE timestamp END AS timestamp,
    CASE WHEN row_id % 89 = 0 THEN NULL ELSE power_watts END AS power_watts FROM tel"""


def raw_csv(spark, sf):
    """Raw files of two kinds, whose headers differ in order."""
    path = scratch_path(spark, "raw")
    rows = dirty(spark, sf)
    odd = rows.where("row_id % 2 = 1").drop("row_id")
    reports.write_tables(rows.where("row_id % 2 = 0").drop("row_id"), path, "csv")
    reports.write_tables(odd.select(*[F.col(f"`{c}`") for c in reversed(odd.columns)]), path, "csv", mode="append")
    return path


# 1-8 sources
add(
    "read_power_csv",
    lambda s, f: readers.read_power_csv(s, raw_csv(s, f)),
    f"""SELECT ' ' || hostname || ' ' AS hostname, gpu_name || '  ' AS gpu_name, ' ' || pci_bus_id AS pci_bus_id,
    CASE WHEN row_id % 97 = 0 THEN 'bad' ELSE strftime(timestamp, '%Y/%m/%d %H:%M:%S.%f') END AS timestamp,
    CASE WHEN row_id % 89 = 0 THEN NULL ELSE power_watts END AS power_watts FROM tel""",
    d="power_watts", with_="tel",
)
add(
    "scan_projected",
    lambda s, f: readers.scan_projected(s, raw_csv(s, f), ["hostname", "power_watts"]),
    "SELECT ' ' || hostname || ' ' AS hostname, CASE WHEN row_id % 89 = 0 THEN NULL ELSE power_watts END AS power_watts FROM tel",
    d="power_watts", with_="tel",
)


def chunked(s, f):
    path = scratch_path(s, "chunks")
    clean_rows = tel(s, f).select(
        "hostname", "gpu_name", "pci_bus_id",
        F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("timestamp"), "power_watts",
    )
    reports.write_tables(clean_rows.repartition(4), path, "csv")
    rows = clean.clean_telemetry(readers.chunked_ingest(s, path, RAW, 1))
    return jobs.run_and_read(s, rows, "ingested")


add(
    "chunked_ingest", chunked,
    "SELECT hostname, gpu_name, pci_bus_id, timestamp, power_watts, hostname || '_' || pci_bus_id AS gpu_id FROM tel",
    d="power_watts", t="timestamp", with_="tel",
)


def reuse(s, f):
    path = scratch_path(s, "reduced")
    for _ in range(2):  # built once, then only read
        out = readers.reuse_reduced(s, path, lambda: downsample.gpu_downsample(tel(s, f)))
    return out.select(*GPU_KEYS, "timestamp", "power_watts")


add("reuse_reduced", reuse, "SELECT * FROM red", d="power_watts", t="timestamp", with_="red")


def stored_reduced(s, f):
    path = scratch_path(s, "reduced")
    holes = red(s, f).withColumn(
        "power_watts", F.when(F.hour("timestamp") != 3, F.col("power_watts"))
    )
    reports.write_tables(holes, path)
    return readers.read_reduced(s, path)


add(
    "read_reduced", stored_reduced, "SELECT * FROM red WHERE hour(timestamp) <> 3",
    d="power_watts", t="timestamp", with_="red",
)
add(
    "recluster_input", lambda s, f: readers.recluster_input(clu(s, f)).select("row_id", "gpu_id", "power_watts"),
    "SELECT row_id, gpu_id, power_watts FROM clu", d="power_watts", i="row_id", with_="clu",
)
add("count_readings", lambda s, f: readers.count_readings(tel(s, f)), "SELECT count(*) AS n_rows FROM events", i="n_rows")
add(
    "dataset_summary", lambda s, f: readers.dataset_summary(red(s, f)),
    """SELECT count(*) AS n_rows, count(DISTINCT hostname) AS n_hosts, count(DISTINCT pci_bus_id) AS n_bus_ids,
    1 AS first_day, max(day_num) AS last_day FROM redt""",
    i="n_rows n_hosts n_bus_ids first_day last_day", with_="redt",
)



@stored
def day_sketches(s, f):
    return readers.daily_sketches(clean.gpu_id(tel(s, f)), ["hostname", "pci_bus_id", "gpu_id", "row_id"])


RANGES = [("all", "1900-01-01", "2199-12-31"), ("first", "2024-01-01", "2024-01-07"), ("middle", "2024-01-10", "2024-01-20"), ("day", "2024-01-15", "2024-01-15")]


def summaries_of_ranges(s, f):
    ranges = s.createDataFrame(RANGES, "name string, from string, to string").select("name", F.to_date("from").alias("from"), F.to_date("to").alias("to"))
    found = readers.range_summaries(day_sketches(s, f), ranges)
    near = F.abs(F.col("n_row_id") - F.col("n_rows")) <= 4 * readers.SKETCH_ERROR * F.col("n_rows")
    return found.withColumn("n_row_id", near.cast("int"))


# Row ids are all different, so their estimate is held against the number of rows: 1 if within four standard errors.
add(
    "dataset_summary_ranges", summaries_of_ranges,
    f"""SELECT name, count(*) AS n_rows, min(timestamp) AS first, max(timestamp) AS last, count(DISTINCT hostname) AS n_hostname,
    count(DISTINCT pci_bus_id) AS n_pci_bus_id, count(DISTINCT gpu_id) AS n_gpu_id, 1 AS n_row_id
    FROM timed JOIN (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in RANGES)}) r(name, a, b)
    ON CAST(timestamp AS DATE) BETWEEN a AND b GROUP BY name""",
    i="n_rows n_hostname n_pci_bus_id n_gpu_id n_row_id", t="first last", with_="timed",
)

# 9-16 cleaning
add(
    "clean_headers", lambda s, f: clean.clean_headers(dirty(s, f)),
    """SELECT row_id, ' ' || hostname || ' ' AS hostname, gpu_name || '  ' AS gpu_name, ' ' || pci_bus_id AS pci_bus_id,
    CASE WHEN row_id % 97 = 0 THEN 'bad' ELSE strftime(timestamp, '%Y/%m/%d %H:%M:%S.%f') END AS timestamp,
    CASE WHEN row_id % 89 = 0 THEN NULL ELSE power_watts END AS power_watts FROM tel""",
    d="power_watts", i="row_id", with_="tel",
)
add(
    "trim_strings",
    lambda s, f: clean.trim_strings(clean.clean_headers(dirty(s, f))).select("row_id", "hostname", "gpu_name", "pci_bus_id"),
    "SELECT row_id, hostname, gpu_name, pci_bus_id FROM tel", i="row_id", with_="tel",
)
add(
    "parse_ts_strict",
    lambda s, f: clean.parse_ts_strict(clean.clean_headers(dirty(s, f))).select("row_id", "timestamp"),
    "SELECT row_id, CASE WHEN row_id % 97 = 0 THEN NULL ELSE timestamp END AS timestamp FROM tel",
    i="row_id", t="timestamp", with_="tel",
)


def mixed_formats(s, f):
    ts = F.col("timestamp")
    text = (
        F.when(F.col("row_id") % 3 == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSSSSS"))
        .when(F.col("row_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
    return clean.parse_ts_lenient(tel(s, f).select("row_id", text.alias("timestamp")))


add(
    "parse_ts_lenient", mixed_formats,
    "SELECT row_id, CASE WHEN row_id % 3 = 1 THEN date_trunc('second', timestamp) ELSE timestamp END AS timestamp FROM tel",
    i="row_id", t="timestamp", with_="tel",
)
add(
    "drop_invalid",
    lambda s, f: clean.drop_invalid(clean.parse_ts_strict(clean.trim_strings(clean.clean_headers(dirty(s, f))))),
    f"SELECT * FROM ({DIRTY}) WHERE timestamp IS NOT NULL AND power_watts IS NOT NULL",
    d="power_watts", i="row_id", t="timestamp", with_="tel",
)
add(
    "data_quality", lambda s, f: clean.data_quality(clean.parse_ts_strict(clean.clean_headers(dirty(s, f)))),
    f"""SELECT count(*) AS rows_loaded, count(*) FILTER (timestamp IS NULL) AS bad_timestamp,
    count(*) FILTER (timestamp IS NOT NULL AND power_watts IS NULL) AS bad_power,
    count(*) FILTER (timestamp IS NOT NULL AND power_watts IS NOT NULL) AS rows_kept FROM ({DIRTY})""",
    i="rows_loaded bad_timestamp bad_power rows_kept", with_="tel",
)
add(
    "gpu_id", lambda s, f: clean.gpu_id(tel(s, f)).select("row_id", "gpu_id"),
    "SELECT row_id, hostname || '_' || pci_bus_id AS gpu_id FROM tel", i="row_id", with_="tel",
)
add(
    "gpu_type", lambda s, f: clean.gpu_type(tel(s, f)).groupBy("gpu_name", "gpu_type").count(),
    "SELECT gpu_name, gpu_type, count(*) AS count FROM timed GROUP BY ALL", i="count", with_="timed",
)


# 17-19 sinks and reports
def peak_split_tables(s, f):
    path = scratch_path(s, "clustered")
    reports.write_tables(clu(s, f), path, partition_by=("is_peak",))
    return s.read.parquet(path).groupBy("is_peak").agg(F.count(F.lit(1)).alias("n"))


add("write_tables", peak_split_tables, "SELECT is_peak, count(*) AS n FROM clu GROUP BY is_peak", i="is_peak n", with_="clu")

FIXED = "CAST(CAST(floor({0} * 10000 + 0.5000001) / 10000 AS DECIMAL(24,4)) AS VARCHAR)"
watts = FIXED.format("avg_power")
NUMBER = "floor({0} * 10000 + 0.5000001) / 10000"
watts_number = NUMBER.format("avg_power")
REPORT = f"""SELECT CAST(json_object(
  'parameters', json_object('epsilon', 0.161::DOUBLE, 'min_samples', 20),
  'key_insights', json_object('peak_hours', (SELECT to_json(list(CAST(hour AS INTEGER) ORDER BY hour)) FROM peak),
    'density_peak', (SELECT {NUMBER.format("avg(CASE WHEN cluster <> -1 THEN 1.0 ELSE 0.0 END)")} FROM clu WHERE is_peak = 1),
    'density_non_peak', (SELECT {NUMBER.format("avg(CASE WHEN cluster <> -1 THEN 1.0 ELSE 0.0 END)")} FROM clu WHERE is_peak = 0)),
  'outlier_findings', json_object('n_clusters', (SELECT count(DISTINCT cluster) FROM clu WHERE cluster <> -1),
    'n_outliers', (SELECT count(*) FROM clu WHERE cluster = -1),
    'outlier_pct', (SELECT {NUMBER.format("avg(CASE WHEN cluster = -1 THEN 100.0::DOUBLE ELSE 0 END)")} FROM clu),
    'top_outlier_gpus', (SELECT to_json(list({{'key': k, 'value': n}} ORDER BY n DESC, k)) FROM
      (SELECT gpu_id AS k, count(*) AS n FROM clu WHERE cluster = -1 GROUP BY k ORDER BY n DESC, k LIMIT 5)),
    'top_outlier_hours', (SELECT to_json(list({{'key': k, 'value': n}} ORDER BY n DESC, k)) FROM
      (SELECT hour AS k, count(*) AS n FROM clu WHERE cluster = -1 GROUP BY k ORDER BY n DESC, k LIMIT 3))),
  'workload', json_object(
    'load_by_node', (SELECT to_json(list({{'key': k, 'value': {watts_number}}} ORDER BY k)) FROM
      (SELECT hostname AS k, avg(power_watts) AS avg_power FROM clu GROUP BY k)),
    'load_by_gpu_type', (SELECT to_json(list({{'key': k, 'value': {watts_number}}} ORDER BY k)) FROM
      (SELECT gpu_type AS k, avg(power_watts) AS avg_power FROM clu GROUP BY k)),
    'high_load_gpus', (SELECT to_json(list({{'key': k, 'value': {watts_number}}} ORDER BY avg_power DESC, k)) FROM
      (SELECT gpu_id AS k, avg(power_watts) AS avg_power FROM clu GROUP BY k ORDER BY avg_power DESC, k LIMIT 5)))
  ) AS VARCHAR) AS report"""
add("report_json", lambda s, f: reports.report_json(clu(s, f), 0.161), REPORT, with_="clu peak")
add(
    "report_rows", lambda s, f: reports.analysis_report(clu(s, f)),
    f"""SELECT 'clusters' AS section, 'n_clusters' AS key, CAST(count(DISTINCT cluster) AS VARCHAR) AS value FROM clu WHERE cluster <> -1
    UNION ALL SELECT 'noise_pct', 'outlier_pct', {FIXED.format("avg(CASE WHEN cluster = -1 THEN 100.0::DOUBLE ELSE 0 END)")} FROM clu
    UNION ALL SELECT 'peak_hours', CAST(hour AS VARCHAR), {watts} FROM peak
    UNION ALL (SELECT 'top_outlier_gpus', gpu_id, CAST(count(*) AS VARCHAR) FROM clu WHERE cluster = -1 GROUP BY gpu_id ORDER BY count(*) DESC, gpu_id LIMIT 5)
    UNION ALL (SELECT 'top_outlier_hours', CAST(hour AS VARCHAR), CAST(count(*) AS VARCHAR) FROM clu WHERE cluster = -1 GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 3)
    UNION ALL SELECT 'load_by_node', hostname, {FIXED.format("avg(power_watts)")} FROM clu GROUP BY hostname
    UNION ALL SELECT 'load_by_gpu_type', gpu_type, {FIXED.format("avg(power_watts)")} FROM clu GROUP BY gpu_type
    UNION ALL (SELECT 'high_load_gpus', gpu_id, {FIXED.format("avg(power_watts)")} FROM clu GROUP BY gpu_id ORDER BY avg(power_watts) DESC, gpu_id LIMIT 5)""",
    with_="clu peak",
)

# 20-28 time and label columns
add(
    "time_features", lambda s, f: timefeat.time_features(tel(s, f)).select("row_id", "hour", "day", "day_of_week"),
    "SELECT row_id, hour, day, day_of_week FROM timed", i="row_id hour day day_of_week", with_="timed",
)
add(
    "calendar_features",
    lambda s, f: timefeat.calendar_features(tel(s, f)).select("row_id", "day_name", "date", "date_text"),
    "SELECT row_id, dayname(timestamp) AS day_name, CAST(timestamp AS DATE) AS date, strftime(timestamp, '%Y-%m-%d') AS date_text FROM tel",
    i="row_id", dt="date", with_="tel",
)
add(
    "day_number", lambda s, f: timefeat.day_number(tel(s, f), label=True).select("row_id", "day_num", "day_label"),
    """SELECT row_id, n AS day_num, 'Day ' || n AS day_label FROM (SELECT row_id,
    CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM tel)) / 86400000000) AS BIGINT) + 1 AS n FROM tel)""",
    i="row_id day_num", with_="tel",
)
add(
    "floor_5min", lambda s, f: timefeat.floor_5min(tel(s, f)).select("row_id", "bucket"),
    "SELECT row_id, time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket FROM tel", i="row_id", t="bucket", with_="tel",
)
add(
    "day_range_subset",
    lambda s, f: subs(s, f).groupBy("subset", "day_num").agg(F.count(F.lit(1)).alias("n")),
    "SELECT subset, day_num, count(*) AS n FROM subs GROUP BY ALL", i="day_num n", with_="subs",
)
BAND = """CASE WHEN hour < 6 THEN 'Night (0-6)' WHEN hour < 12 THEN 'Morning (6-12)' WHEN hour < 18 THEN 'Afternoon (12-18)'
    ELSE 'Evening (18-24)' END"""
add(
    "time_bands", lambda s, f: timefeat.time_bands(timefeat.time_features(tel(s, f))).select("row_id", "time_band"),
    f"SELECT row_id, {BAND} AS time_band FROM timed", i="row_id", with_="timed",
)
PART = """CASE WHEN {0} >= 6 AND {0} < 18 THEN 'Daytime' WHEN {0} >= 18 AND {0} < 22 THEN 'Evening' ELSE 'Night/Early Morning' END"""
add(
    "daypart_label", lambda s, f: timefeat.daypart_label(timefeat.time_features(tel(s, f))).select("row_id", "daypart"),
    f"SELECT row_id, {PART.format('hour')} AS daypart FROM timed", i="row_id", with_="timed",
)
add(
    "workload_state", lambda s, f: workload.workload_state(redt(s, f)).select(*GPU_KEYS, "timestamp", "state"),
    "SELECT hostname, pci_bus_id, timestamp, state FROM state", t="timestamp", with_="state",
)
add(
    "std_label",
    lambda s, f: patterns.std_label(sublab(s, f)).groupBy("global_cluster_label", "interpretation").count(),
    """SELECT global_cluster_label, CASE global_cluster_label WHEN 'Low usage / idle cluster' THEN 'Idle / Low usage cluster'
    WHEN 'Medium usage cluster' THEN 'Moderate usage cluster' ELSE 'High spike cluster' END AS interpretation, count(*) AS count
    FROM sublab GROUP BY ALL""",
    i="count", with_="sublab",
)

# 29-35 rules
V2 = """CASE WHEN avg_power < 100 AND power_var < 500 THEN 'Idle/Low Load' WHEN avg_power < 150 AND power_var < 1000 THEN 'Moderate Load'
    WHEN avg_power >= 150 AND power_var < 2000 THEN 'High Load' ELSE 'Burst/Unstable' END"""
add(
    "behavior_label_v2", lambda s, f: behavior.behavior_label_v2(behavior.cluster_stats(clu(s, f))),
    f"SELECT *, {V2} AS behavior_label FROM stats", d="avg_power power_var avg_delta", i="cluster point_count", with_="stats",
)
add(
    "behavior_label_final", lambda s, f: behavior.behavior_label_final(behavior.cluster_stats(clu(s, f))),
    "SELECT * FROM slab", d="avg_power power_var avg_delta", i="cluster point_count", with_="slab",
)
add(
    "outlier_type_v2",
    lambda s, f: behavior.outlier_type_v2(clu(s, f)).where("cluster = -1").select("row_id", "outlier_type"),
    """SELECT row_id, CASE WHEN abs(power_delta) > pd THEN 'Spike Event' WHEN power_watts > pp THEN 'Sustained High-Load Anomaly'
    ELSE 'Erratic Fluctuation' END AS outlier_type FROM clu CROSS JOIN p95 WHERE cluster = -1""",
    i="row_id", with_="clu p95",
)
add(
    "outlier_type_final",
    lambda s, f: behavior.outlier_type_final(clu(s, f)).where("cluster = -1").select("row_id", "outlier_type"),
    "SELECT row_id, outlier_type FROM lab WHERE cluster = -1", i="row_id", with_="lab",
)

SHARES = ", ".join(
    f"""avg(CASE WHEN behavior_label = '{x}' THEN 100.0::DOUBLE ELSE 0 END) AS "{share_column(x)}\"""" for x in ALL_LABELS
)
SHARE_COLS = " ".join(share_column(x) for x in ALL_LABELS)
PROFILE = f"""SELECT gpu_id, avg(power_watts) AS power_watts_mean, var_samp(power_watts) AS power_watts_var, {SHARES}
    FROM lab GROUP BY gpu_id"""
OUTSHARE = '(pct_time_spike_event + "pct_time_sustained_high-load_anomaly" + pct_time_erratic_fluctuation + pct_time_outlier)'
CLASS = f"""CASE WHEN {OUTSHARE} > {{0}} OR pct_time_spike_event > {{1}} THEN 'Unstable / Spiky'
    WHEN pct_time_high_load > 40 {{2}} THEN 'High-Load Consistent' ELSE 'Stable' END"""
add(
    "gpu_class_v2",
    lambda s, f: behavior.gpu_class_v2(behavior.gpu_profile(lab(s, f))).select("gpu_id", "gpu_classification"),
    f"SELECT gpu_id, {CLASS.format(10, 5, '')} AS gpu_classification FROM ({PROFILE})", with_="lab",
)
add(
    "gpu_class_final",
    lambda s, f: behavior.gpu_class_final(behavior.gpu_profile(lab(s, f))).select("gpu_id", "gpu_classification"),
    f"SELECT gpu_id, {CLASS.format(10, 5, 'OR pct_time_extreme_load > 10')} AS gpu_classification FROM ({PROFILE})", with_="lab",
)
add(
    "overall_pattern", lambda s, f: workload.overall_pattern(redt(s, f)),
    """SELECT cv, CASE WHEN cv > 0.5 THEN 'BURSTY' ELSE 'BALANCED' END AS pattern
    FROM (SELECT stddev_samp(power_watts) / avg(power_watts) AS cv FROM redt)""",
    d="cv", with_="redt",
)

# 36-41 filters and peaks
add(
    "filter_host",
    lambda s, f: peaks.filter_host(tel(s, f), "node03", "click").select("row_id", "timestamp", "power_watts"),
    "SELECT row_id, timestamp, power_watts FROM tel WHERE hostname = 'node03' AND pci_bus_id = 'click'",
    d="power_watts", i="row_id", t="timestamp", with_="tel",
)


def flagged(s, f):
    rows = timefeat.time_features(tel(s, f))
    return peaks.is_peak(rows, peaks.peak_hours(rows))


add(
    "is_peak", lambda s, f: flagged(s, f).select("row_id", "is_peak"),
    "SELECT row_id, CAST(hour IN (SELECT hour FROM peak) AS INTEGER) AS is_peak FROM timed",
    i="row_id is_peak", with_="timed peak",
)


def both_sides(s, f):
    on, off = peaks.split_peak(flagged(s, f))
    total = [F.count(F.lit(1)).alias("n"), F.avg("power_watts").alias("avg_power")]
    return on.agg(F.lit("peak").alias("side"), *total).unionByName(off.agg(F.lit("non_peak").alias("side"), *total))


add(
    "split_peak", both_sides,
    "SELECT CASE is_peak WHEN 1 THEN 'peak' ELSE 'non_peak' END AS side, count(*) AS n, avg(power_watts) AS avg_power FROM telf GROUP BY side",
    d="avg_power", i="n", with_="telf",
)
RED = [*GPU_KEYS, "timestamp", "power_watts"]
RCOLS = "hostname, pci_bus_id, timestamp, power_watts"
add(
    "peak_by_quantile", lambda s, f: peaks.peak_by_quantile(redt(s, f)).select(*RED),
    f"SELECT {RCOLS} FROM redt WHERE power_watts >= (SELECT quantile_cont(power_watts, 0.8::DOUBLE) FROM redt)",
    d="power_watts", t="timestamp", with_="redt",
)
add(
    "peak_by_hours", lambda s, f: peaks.peak_by_hours(redt(s, f)).select(*RED),
    f"SELECT {RCOLS} FROM redt WHERE hour BETWEEN 18 AND 23", d="power_watts", t="timestamp", with_="redt",
)
CHOICE = """SELECT r.*, CASE WHEN w THEN 'peak_top20pct' ELSE 'peak_18h_23h' END AS peak_label FROM redt r CROSS JOIN
    (SELECT c, count(*) FILTER (power_watts >= c) >= count(*) FILTER (hour BETWEEN 18 AND 23) AS w FROM redt CROSS JOIN
      (SELECT quantile_cont(power_watts, 0.8::DOUBLE) AS c FROM redt) GROUP BY c)
    WHERE CASE WHEN w THEN power_watts >= c ELSE hour BETWEEN 18 AND 23 END"""
add(
    "peak_choice", lambda s, f: peaks.peak_choice(redt(s, f)).select(*RED, "peak_label"),
    f"SELECT {RCOLS}, peak_label FROM ({CHOICE})", d="power_watts", t="timestamp", with_="redt",
)

# 42-44 label joins
add(
    "map_cluster_label",
    lambda s, f: behavior.map_cluster_label(
        clu(s, f), behavior.behavior_label_final(behavior.cluster_stats(clu(s, f)))
    ).select("row_id", "behavior_label"),
    "SELECT row_id, CASE WHEN cluster = -1 THEN 'Outlier' ELSE behavior_label END AS behavior_label FROM clu LEFT JOIN slab USING (cluster)",
    i="row_id", with_="clu slab",
)
add(
    "relabel_outliers", lambda s, f: behavior.label_behavior(clu(s, f)).select("row_id", "behavior_label"),
    "SELECT row_id, behavior_label FROM lab", i="row_id", with_="lab",
)
TOP20 = "(SELECT gpu_id FROM lab GROUP BY gpu_id ORDER BY avg(power_watts) DESC, gpu_id LIMIT 20)"
add(
    "top_gpu_rows",
    lambda s, f: behavior.top_gpu_rows(lab(s, f), behavior.gpu_profile(lab(s, f))).select("row_id", "gpu_id"),
    f"SELECT row_id, gpu_id FROM lab WHERE gpu_id IN {TOP20}", i="row_id", with_="lab",
)

# 48-64 aggregations
add("node_downsample", lambda s, f: downsample.node_downsample(tel(s, f)), "SELECT * FROM node", d="power_watts", t="timestamp", with_="node")
add("gpu_downsample", lambda s, f: downsample.gpu_downsample(tel(s, f)), "SELECT * FROM red", d="power_watts", t="timestamp", with_="red")
add(
    "node_downsample_mean_draw", lambda s, f: downsample.node_downsample(tel(s, f), mode="mean_draw"),
    "SELECT hostname, timestamp, sum(power_watts) AS power_watts FROM red GROUP BY ALL", d="power_watts", t="timestamp", with_="red",
)
add(
    "downsample_sizes", lambda s, f: downsample.downsample_sizes(node(s, f), red(s, f)),
    "SELECT (SELECT count(*) FROM node) AS node_rows, (SELECT count(*) FROM red) AS gpu_rows", i="node_rows gpu_rows", with_="node red",
)
MOMENTS = "avg(power_watts) AS mean, var_samp(power_watts) AS variance, stddev_samp(power_watts) AS std_dev"
NSTATS = f"SELECT hostname, 'NODE_TOTAL' AS pci_bus_id, {MOMENTS} FROM node GROUP BY hostname"
GSTATS = f"SELECT hostname, pci_bus_id, {MOMENTS} FROM red GROUP BY ALL"
add("node_stats", lambda s, f: stats.node_stats(node(s, f)), NSTATS, d="mean variance std_dev", with_="node")
add("gpu_stats", lambda s, f: stats.gpu_stats(red(s, f)), GSTATS, d="mean variance std_dev", with_="red")
METRICS = """SELECT s.subset, avg(s.power_watts) AS mean_power, var_samp(s.power_watts) AS variance, coalesce(any_value(n), 0) AS spikes
    FROM subs s LEFT JOIN (SELECT subset, count(*) AS n FROM subout GROUP BY subset) USING (subset) GROUP BY s.subset"""
add(
    "subset_metrics", lambda s, f: stats.subset_metrics(subs(s, f), subout(s, f)), METRICS,
    d="mean_power variance", i="spikes", with_="subs subout",
)
add(
    "subset_compare", lambda s, f: stats.subset_compare(settle(stats.subset_metrics(subs(s, f), subout(s, f)))),
    f"""WITH m AS MATERIALIZED ({METRICS}) SELECT (SELECT subset FROM m ORDER BY variance DESC, subset LIMIT 1) AS highest_variance,
    (SELECT subset FROM m ORDER BY spikes DESC, subset LIMIT 1) AS most_spikes,
    (SELECT subset FROM m ORDER BY variance, subset LIMIT 1) AS most_stable""",
    with_="subs subout",
)
add(
    "hourly_avg", lambda s, f: peaks.hourly_avg(timefeat.time_features(tel(s, f))), "SELECT * FROM hours",
    d="avg_power", i="hour", with_="hours",
)
add(
    "peak_hours", lambda s, f: peaks.peak_hours(timefeat.time_features(tel(s, f))), "SELECT * FROM peak",
    d="avg_power", i="hour", with_="peak",
)
add(
    "load_by_node", lambda s, f: stats.load_by_node(tel(s, f)),
    "SELECT hostname, avg(power_watts) AS avg_power FROM tel GROUP BY hostname", d="avg_power", with_="tel",
)
add(
    "load_by_gpu_type", lambda s, f: stats.load_by_gpu_type(clean.gpu_type(tel(s, f))),
    "SELECT gpu_type, avg(power_watts) AS avg_power FROM timed GROUP BY gpu_type", d="avg_power", with_="timed",
)
add(
    "node_extremes", lambda s, f: stats.node_extremes(tel(s, f)),
    """WITH m AS (SELECT hostname AS h, avg(power_watts) AS p FROM tel GROUP BY hostname)
    SELECT a.h AS top_node, a.p AS top_power, b.h AS low_node, b.p AS low_power
    FROM (SELECT * FROM m ORDER BY p DESC, h LIMIT 1) a CROSS JOIN (SELECT * FROM m ORDER BY p, h LIMIT 1) b""",
    d="top_power low_power", with_="tel",
)
add(
    "high_load_gpus", lambda s, f: stats.high_load_gpus(clean.gpu_id(tel(s, f))),
    "SELECT gpu_id, avg(power_watts) AS avg_power FROM timed GROUP BY gpu_id ORDER BY avg_power DESC, gpu_id LIMIT 5",
    d="avg_power", with_="timed",
)
add(
    "outlier_type_counts", lambda s, f: behavior.outlier_type_counts(lab(s, f)),
    "SELECT outlier_type, count(*) AS n FROM lab WHERE cluster = -1 GROUP BY outlier_type", i="n", with_="lab",
)
NOISE = "SELECT {0}, count(*) AS n FROM clu WHERE cluster = -1 GROUP BY {0}"
add(
    "top_outlier_gpus", lambda s, f: behavior.top_outlier_gpus(clu(s, f)),
    NOISE.format("gpu_id") + " ORDER BY n DESC, gpu_id LIMIT 5", i="n", with_="clu",
)
add(
    "top_outlier_hours", lambda s, f: behavior.top_outlier_hours(clu(s, f), 5),
    NOISE.format("hour") + " ORDER BY n DESC, hour LIMIT 5", i="hour n", with_="clu",
)
add("outliers_per_hour", lambda s, f: behavior.outliers_per_hour(clu(s, f)), NOISE.format("hour"), i="hour n", with_="clu")

# 65-73 clusters and profiles
add(
    "cluster_stats", lambda s, f: behavior.cluster_stats(clu(s, f)), "SELECT * FROM stats",
    d="avg_power power_var avg_delta", i="cluster point_count", with_="stats",
)
add(
    "cluster_share",
    lambda s, f: behavior.cluster_share(behavior.cluster_stats(clu(s, f)), clu(s, f)).select("cluster", "point_count", "pct_of_total"),
    "SELECT cluster, point_count, point_count / (SELECT count(*) FROM clu) * 100 AS pct_of_total FROM stats",
    d="pct_of_total", i="cluster point_count", with_="stats",
)
add(
    "cluster_census", lambda s, f: behavior.cluster_census(clu(s, f)),
    """SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(*) FILTER (cluster = -1) AS n_outliers,
    count(*) FILTER (cluster = -1) / count(*) * 100 AS outlier_pct FROM clu""",
    d="outlier_pct", i="n_clusters n_outliers", with_="clu",
)
add(
    "inlier_density", lambda s, f: peaks.inlier_density(clu(s, f)),
    """SELECT count(*) FILTER (is_peak = 1 AND cluster <> -1) / count(*) FILTER (is_peak = 1) AS peak,
    count(*) FILTER (is_peak = 0 AND cluster <> -1) / count(*) FILTER (is_peak = 0) AS non_peak FROM clu""",
    d="peak non_peak", with_="clu",
)
add(
    "gpu_profile", lambda s, f: behavior.gpu_profile(lab(s, f)), PROFILE,
    d=f"power_watts_mean power_watts_var {SHARE_COLS}", with_="lab",
)
add(
    "label_share_map",
    lambda s, f: behavior.label_share_map(lab(s, f)).select("gpu_id", F.explode("label_share").alias("behavior_label", "share")),
    """SELECT gpu_id, behavior_label, count(*) / sum(count(*)) OVER (PARTITION BY gpu_id) AS share
    FROM lab WHERE behavior_label IS NOT NULL GROUP BY gpu_id, behavior_label""",
    d="share", with_="lab",
)
CLASSED = f"SELECT gpu_id, {CLASS.format(10, 5, 'OR pct_time_extreme_load > 10')} AS gpu_classification FROM ({PROFILE})"
add(
    "class_counts", lambda s, f: behavior.class_counts(settle(behavior.gpu_class_final(behavior.gpu_profile(lab(s, f))))),
    f"""WITH c AS MATERIALIZED ({CLASSED}) SELECT gpu_classification, count(*) AS n,
    CASE WHEN gpu_classification = 'Unstable / Spiky' THEN (SELECT string_agg(gpu_id, ',' ORDER BY gpu_id) FROM
    (SELECT gpu_id FROM c WHERE gpu_classification = 'Unstable / Spiky' ORDER BY gpu_id LIMIT 5)) END AS examples
    FROM c GROUP BY gpu_classification""",
    i="n", with_="lab",
)
LABEL_ROWS = "(VALUES " + ", ".join(f"('{x}')" for x in ALL_LABELS) + ") v(label)"
TRANSITION = f"""SELECT is_peak, label AS behavior_label, avg(CASE WHEN behavior_label = label THEN 100.0::DOUBLE ELSE 0 END) AS pct
    FROM lab CROSS JOIN {LABEL_ROWS} GROUP BY is_peak, label"""
add("peak_transition", lambda s, f: behavior.peak_transition(lab(s, f)), TRANSITION, d="pct", i="is_peak", with_="lab")
add(
    "peak_inlier_pct", lambda s, f: behavior.peak_inlier_pct(behavior.peak_transition(lab(s, f))),
    f"SELECT is_peak, sum(pct) - sum(pct) FILTER (behavior_label = 'Spike Event') AS non_spike_pct FROM ({TRANSITION}) GROUP BY is_peak",
    d="non_spike_pct", i="is_peak", with_="lab",
)

# 74-92 patterns and workload
BYLAB = "subset, global_cluster_label"
MODE = """(SELECT {k}, v AS modal_{c} FROM (SELECT {k}, {c} AS v, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {c}) AS r
    FROM {t} GROUP BY {k}, {c}) WHERE r = 1)"""
SUMMARY = f"""SELECT {BYLAB}, avg(power_watts) AS mean_power, min(power_watts) AS min_power, max(power_watts) AS max_power,
    stddev_samp(power_watts) AS std_power, count(*) AS frequency FROM sublab GROUP BY ALL"""
HOURMODE = MODE.format(k=BYLAB, c="hour", t="sublab")
DAYMODE = MODE.format(k=BYLAB, c="day_num", t="sublab")
add(
    "outlier_cluster_summary", lambda s, f: patterns.outlier_cluster_summary(sublab(s, f), ["subset"]),
    f"SELECT * FROM ({SUMMARY}) JOIN {HOURMODE} USING ({BYLAB})",
    d="mean_power min_power max_power std_power", i="frequency modal_hour", with_="sublab",
)
add(
    "outlier_cluster_profile", lambda s, f: patterns.outlier_cluster_profile(sublab(s, f), ["subset"]),
    f"SELECT * FROM ({SUMMARY}) JOIN {HOURMODE} USING ({BYLAB}) JOIN {DAYMODE} USING ({BYLAB})",
    d="mean_power min_power max_power std_power", i="frequency modal_hour modal_day_num", with_="sublab",
)
add(
    "modal_value", lambda s, f: patterns.modal_value(timefeat.time_features(clean.gpu_id(tel(s, f))), ["gpu_id"], "hour"),
    f"SELECT * FROM {MODE.format(k='gpu_id', c='hour', t='timed')}", i="modal_hour", with_="timed",
)
add(
    "timing_pattern", lambda s, f: patterns.timing_pattern(sublab(s, f), ["subset"]),
    f"""SELECT {BYLAB}, n AS n_hours, modal_hour AS dominant_hour, 'Peaks around ' || modal_hour || ':00 (' || {PART.format('modal_hour')} || ')'
    || CASE WHEN n > 8 THEN ', widespread usage' ELSE ', concentrated bursts' END AS timing_pattern
    FROM (SELECT {BYLAB}, count(DISTINCT hour) AS n FROM sublab GROUP BY ALL) JOIN {HOURMODE} USING ({BYLAB})""",
    i="n_hours dominant_hour", with_="sublab",
)


def spike_share(s, f):
    return patterns.subset_spike_share(patterns.std_label(patterns.outlier_cluster_profile(sublab(s, f), ["subset"])))


SPIKE = f"""SELECT subset, coalesce(sum(frequency) FILTER (h), 0) AS high_count, coalesce(sum(frequency) FILTER (h), 0) / sum(frequency) AS high_ratio,
    coalesce(avg(mean_power) FILTER (h), 0) AS avg_high_power, avg(std_power) AS variability
    FROM (SELECT *, global_cluster_label = 'High spike cluster' AS h FROM ({SUMMARY})) GROUP BY subset"""
add("subset_spike_share", spike_share, SPIKE, d="high_ratio avg_high_power variability", i="high_count", with_="sublab")
add(
    "subset_spike_extremes", lambda s, f: patterns.subset_spike_extremes(settle(spike_share(s, f))),
    f"""WITH m AS MATERIALIZED ({SPIKE}) SELECT (SELECT subset FROM m ORDER BY high_count DESC, subset LIMIT 1) AS most_spikes,
    (SELECT subset FROM m ORDER BY variability DESC, subset LIMIT 1) AS most_variable,
    (SELECT subset FROM m ORDER BY variability, subset LIMIT 1) AS least_variable""",
    with_="sublab",
)
add("spike_rows", lambda s, f: patterns.spike_rows(redc(s, f)).select(*RED), f"SELECT {RCOLS} FROM spk", d="power_watts", t="timestamp", with_="spk")
add(
    "spike_hours", lambda s, f: patterns.spike_hours(spk(s, f)),
    "SELECT hour, count(*) AS n FROM spk GROUP BY hour ORDER BY n DESC, hour LIMIT 5", i="hour n", with_="spk",
)
GRID = """SELECT h.hour, a.{0}, count(s.hour) AS n FROM (SELECT DISTINCT hour FROM spk) h CROSS JOIN (SELECT DISTINCT {0} FROM spk) a
    LEFT JOIN spk s ON s.hour = h.hour AND s.{0} = a.{0} GROUP BY ALL"""
add("daily_spike_pivot", lambda s, f: patterns.daily_spike_pivot(spk(s, f)), GRID.format("date"), i="hour n", dt="date", with_="spk")
add("spike_heatmap", lambda s, f: patterns.spike_heatmap(spk(s, f)), GRID.format("day_num"), i="hour day_num n", with_="spk")
add(
    "recurring_hours", lambda s, f: patterns.recurring_hours(redt(s, f), spk(s, f)),
    """SELECT hour, count(DISTINCT date) AS n_days FROM spk GROUP BY hour
    HAVING count(DISTINCT date) >= 0.5 * (SELECT count(DISTINCT date) FROM redt)""",
    i="hour n_days", with_="spk",
)
add(
    "band_dominance", lambda s, f: patterns.band_dominance(redc(s, f)),
    f"""WITH b AS MATERIALIZED (SELECT *, {BAND} AS time_band FROM redc)
    SELECT time_band, mean_power, modal_cluster AS dominant_cluster FROM (SELECT time_band, avg(power_watts) AS mean_power FROM b GROUP BY time_band)
    JOIN {MODE.format(k='time_band', c='cluster', t='b')} USING (time_band)""",
    d="mean_power", i="dominant_cluster", with_="redc",
)
add(
    "day_dominance", lambda s, f: patterns.day_dominance(redc(s, f)),
    f"""SELECT date, mean_power, modal_cluster AS dominant_cluster FROM (SELECT date, avg(power_watts) AS mean_power FROM redc GROUP BY date)
    JOIN {MODE.format(k='date', c='cluster', t='redc')} USING (date)""",
    d="mean_power", i="dominant_cluster", dt="date", with_="redc",
)
add(
    "state_share", lambda s, f: workload.state_share(states(s, f)),
    "SELECT state, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS pct FROM state GROUP BY state",
    d="pct", i="n", with_="state",
)
PCT = "avg(CASE WHEN state = '{0}' THEN 100.0::DOUBLE ELSE 0 END) AS {1}"
add(
    "hourly_state_pct", lambda s, f: workload.hourly_state_pct(states(s, f)),
    f"SELECT hour, {PCT.format('Idle', 'pct_idle')}, {PCT.format('Moderate', 'pct_moderate')}, {PCT.format('Active', 'pct_active')} FROM state GROUP BY hour",
    d="pct_idle pct_moderate pct_active", i="hour", with_="state",
)
CV = "SELECT hour, CASE WHEN avg(power_watts) > 0 THEN stddev_samp(power_watts) / avg(power_watts) ELSE 0 END AS cv FROM redt GROUP BY hour"
add("hourly_cv", lambda s, f: workload.hourly_cv(redt(s, f)), CV, d="cv", i="hour", with_="redt")
add(
    "bursty_hours", lambda s, f: workload.bursty_hours(redt(s, f)),
    f"WITH c AS MATERIALIZED ({CV}) SELECT hour, cv, CASE WHEN cv > (SELECT median(cv) FROM c) THEN 'bursty' ELSE 'balanced' END AS kind FROM c WHERE cv IS NOT NULL",
    d="cv", i="hour", with_="redt",
)
add("overall_cv", lambda s, f: workload.overall_cv(redt(s, f)), "SELECT stddev_samp(power_watts) / avg(power_watts) AS cv FROM redt", d="cv", with_="redt")
add(
    "host_state_ratio", lambda s, f: workload.host_state_ratio(states(s, f)),
    f"SELECT hostname, {PCT.format('Idle', 'idle_pct')}, {PCT.format('Active', 'active_pct')} FROM state GROUP BY hostname",
    d="idle_pct active_pct", with_="state",
)
add(
    "gpu_behavior_heatmap", lambda s, f: behavior.gpu_behavior_heatmap(lab(s, f), behavior.gpu_profile(lab(s, f))),
    f"SELECT gpu_id, {SHARES} FROM lab WHERE gpu_id IN {TOP20} GROUP BY gpu_id", d=SHARE_COLS, with_="lab",
)

# 95-100 windows, sorts
WCOLS = ["row_id", "rolling_mean_power", "power_delta"]
add(
    "rolling_mean", lambda s, f: features.rolling_mean(clean.gpu_id(tel(s, f))).select("row_id", "rolling_mean_power"),
    "SELECT row_id, rolling_mean_power FROM feat", d="rolling_mean_power", i="row_id", with_="feat",
)
add(
    "power_delta", lambda s, f: features.power_delta(clean.gpu_id(tel(s, f))).select("row_id", "power_delta"),
    "SELECT row_id, power_delta FROM feat", d="power_delta", i="row_id", with_="feat",
)
add(
    "telemetry_features",
    lambda s, f: peaks.telemetry_features(tel(s, f)).select(
        "row_id", "gpu_id", "gpu_type", "hour", "day", "day_of_week", "rolling_mean_power", "power_delta", "is_peak"
    ),
    "SELECT row_id, gpu_id, gpu_type, hour, day, day_of_week, rolling_mean_power, power_delta, is_peak FROM telf",
    d="rolling_mean_power power_delta", i="row_id hour day day_of_week is_peak", with_="telf",
)
add(
    "label_encode",
    lambda s, f: features.label_encode(subout(s, f), "pci_bus_id", ["subset"]).select("subset", *RED, "encoded_pci_bus_id"),
    f"SELECT subset, {RCOLS}, dense_rank() OVER (PARTITION BY subset ORDER BY pci_bus_id) - 1 AS encoded_pci_bus_id FROM subout",
    d="power_watts", i="encoded_pci_bus_id", t="timestamp", with_="subout",
)
add(
    "rank_clusters",
    lambda s, f: patterns.rank_clusters(
        clu(s, f).where("cluster <> -1").groupBy("hostname", "cluster").agg(F.avg("power_watts").alias("mean_power")),
        ["hostname"], "cluster", "mean_power",
    ),
    """SELECT hostname, cluster, avg(power_watts) AS mean_power,
    row_number() OVER (PARTITION BY hostname ORDER BY avg(power_watts), cluster) AS rank FROM clu WHERE cluster <> -1 GROUP BY hostname, cluster""",
    d="mean_power", i="cluster rank", with_="clu",
)
add(
    "sort_chrono", lambda s, f: stats.sort_chrono(tel(s, f)).select("row_id", "timestamp"),
    "SELECT row_id, timestamp FROM tel ORDER BY timestamp, row_id", i="row_id", t="timestamp", with_="tel",
)
add(
    "top_k", lambda s, f: stats.top_k(tel(s, f), "power_watts", 25, ["row_id"]).select("row_id", "power_watts"),
    "SELECT row_id, power_watts FROM tel ORDER BY power_watts DESC, row_id LIMIT 25", d="power_watts", i="row_id", with_="tel",
)

# 101-119 outliers and distribution tables
FENCE = """SELECT t.* FROM {t} t JOIN (SELECT {k}, quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.75::DOUBLE) AS q3
    FROM {t} GROUP BY ALL) q USING ({k}) WHERE power_watts < q1 - 1.5 * (q3 - q1) OR power_watts > q3 + 1.5 * (q3 - q1)"""
add(
    "iqr_outliers_global", lambda s, f: outliers.iqr_outliers_global(red(s, f)).select(*RED),
    f"""SELECT {RCOLS} FROM red CROSS JOIN (SELECT quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.75::DOUBLE) AS q3 FROM red)
    WHERE power_watts < q1 - 1.5 * (q3 - q1) OR power_watts > q3 + 1.5 * (q3 - q1)""",
    d="power_watts", t="timestamp", with_="red",
)
add(
    "iqr_outliers_grouped", lambda s, f: outliers.iqr_outliers_grouped(tel(s, f), GPU_KEYS).select("row_id", *GPU_KEYS, "power_watts"),
    f"SELECT row_id, hostname, pci_bus_id, power_watts FROM ({FENCE.format(t='tel', k='hostname, pci_bus_id')})",
    d="power_watts", i="row_id", with_="tel",
)
NOUT = f"SELECT hostname, 'NODE_TOTAL' AS pci_bus_id, timestamp, power_watts FROM ({FENCE.format(t='node', k='hostname')})"
GOUT = f"SELECT {RCOLS} FROM ({FENCE.format(t='red', k='hostname, pci_bus_id')})"
add("node_outliers", lambda s, f: outliers.node_outliers(node(s, f)), NOUT, d="power_watts", t="timestamp", with_="node")
add("gpu_outliers", lambda s, f: outliers.gpu_outliers(red(s, f)), GOUT, d="power_watts", t="timestamp", with_="red")
add(
    "subset_outliers", lambda s, f: outliers.subset_outliers(subs(s, f)).select("subset", *RED),
    f"SELECT subset, {RCOLS} FROM subout", d="power_watts", t="timestamp", with_="subout",
)
add(
    "all_outliers", lambda s, f: outliers.all_outliers(node(s, f), red(s, f)), f"{NOUT} UNION ALL {GOUT}",
    d="power_watts", t="timestamp", with_="node red",
)

BOX = """SELECT {k}, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
    min(power_watts) FILTER (ok) AS whisker_low, max(power_watts) FILTER (ok) AS whisker_high, avg(power_watts) AS mean,
    count(*) FILTER (NOT ok) AS n_fliers FROM (SELECT {k}, n, q1, median, q3, power_watts,
      power_watts >= q1 - 1.5 * (q3 - q1) AND power_watts <= q3 + 1.5 * (q3 - q1) AS ok
      FROM {t} JOIN (SELECT {k}, count(*) AS n, quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.5::DOUBLE) AS median,
        quantile_cont(power_watts, 0.75::DOUBLE) AS q3 FROM {t} GROUP BY ALL) USING ({k})) GROUP BY {k}"""
BD, BI = "q1 median q3 whisker_low whisker_high mean", "n n_fliers"
DAYKEY = "(SELECT *, 'Day ' || day_num AS day_key FROM redt)"
add("box_stats_node", lambda s, f: stats.box_stats_node(node(s, f)), BOX.format(k="hostname", t="node"), d=BD, i=BI, with_="node")
add("box_stats_gpu", lambda s, f: stats.box_stats_gpu(red(s, f)), BOX.format(k="hostname, pci_bus_id", t="red"), d=BD, i=BI, with_="red")
add("box_stats_daily", lambda s, f: stats.box_stats_daily(red(s, f)), BOX.format(k="day_key", t=DAYKEY), d=BD, i=BI, with_="redt")
add(
    "box_stats_daily_dates", lambda s, f: stats.box_stats_daily(red(s, f), use_day_numbers=False),
    BOX.format(k="day_key", t="(SELECT *, strftime(date, '%Y-%m-%d') AS day_key FROM redt)"), d=BD, i=BI, with_="redt",
)
add("box_stats_node_daily", lambda s, f: stats.box_stats_node_daily(red(s, f)), BOX.format(k="hostname, day_key", t=DAYKEY), d=BD, i=BI, with_="redt")
add(
    "box_stats_subset_daily", lambda s, f: stats.box_stats(subs(s, f), ["subset", "day_num"]),
    BOX.format(k="subset, day_num", t="subs"), d=BD, i=f"{BI} day_num", with_="subs",
)
add("box_stats_peak", lambda s, f: stats.box_stats_peak(telf(s, f)), BOX.format(k="is_peak, hostname", t="telf"), d=BD, i=f"{BI} is_peak", with_="telf")
add("box_stats_gpu_id", lambda s, f: stats.box_stats_gpu_id(telf(s, f)), BOX.format(k="gpu_id", t="timed"), d=BD, i=BI, with_="timed")
add(
    "power_histogram", lambda s, f: stats.power_histogram(redt(s, f)),
    """SELECT bin, mn + bin * ((mx - mn) / 80) AS bin_start, mn + (bin + 1) * ((mx - mn) / 80) AS bin_end, count(*) AS n,
    any_value(lo) AS idle_threshold, any_value(hi) AS active_threshold
    FROM (SELECT least(79, CAST(floor((power_watts - mn) / (mx - mn) * 80) AS INTEGER)) AS bin, mn, mx, lo, hi
      FROM redt CROSS JOIN cuts CROSS JOIN (SELECT min(power_watts) AS mn, max(power_watts) AS mx FROM redt)) GROUP BY bin, mn, mx""",
    d="bin_start bin_end idle_threshold active_threshold", i="bin n", with_="redt cuts",
)
add(
    "host_type_quartiles", lambda s, f: stats.host_type_quartiles(telf(s, f)),
    """SELECT hostname, gpu_type, bin, count(*) AS bin_rows, count(*) / any_value(n) AS share, any_value(q1) AS q1, any_value(median) AS median,
    any_value(q3) AS q3 FROM (SELECT hostname, gpu_type, n, q1, median, q3, least(19, CAST(floor((power_watts - mn) / (mx - mn) * 20) AS INTEGER)) AS bin
      FROM timed JOIN (SELECT hostname, gpu_type, count(*) AS n, min(power_watts) AS mn, max(power_watts) AS mx,
        quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.5::DOUBLE) AS median, quantile_cont(power_watts, 0.75::DOUBLE) AS q3
        FROM timed GROUP BY ALL) USING (hostname, gpu_type)) GROUP BY hostname, gpu_type, bin""",
    d="share q1 median q3", i="bin bin_rows", with_="timed",
)
add("power_timeline_node", lambda s, f: downsample.power_timeline_node(tel(s, f)), "SELECT * FROM node", d="power_watts", t="timestamp", with_="node")
add("power_timeline_gpu", lambda s, f: downsample.power_timeline_gpu(tel(s, f)), "SELECT * FROM red", d="power_watts", t="timestamp", with_="red")
SAMPLE = "(SELECT * FROM {t} ORDER BY md5(CAST(row_id AS VARCHAR)), row_id LIMIT {n})"
add(
    "timeline_sampled", lambda s, f: stats.timeline_sampled(tel(s, f)),
    """SELECT hostname, time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket, avg(power_watts) AS avg_power, count(*) AS n
    FROM tel GROUP BY ALL""",
    d="avg_power", i="n", t="bucket", with_="tel",
)
# The same sums in SQL: bins of each group's range, then a kernel at every bin's mean.
add(
    "host_type_density", lambda s, f: stats.host_type_density(telf(s, f)),
    """WITH shape AS (SELECT hostname, gpu_type, count(*) AS n, min(power_watts) AS mn, max(power_watts) AS mx,
        stddev_samp(power_watts) * power(count(*), -0.2::DOUBLE) AS h FROM timed GROUP BY ALL HAVING min(power_watts) < max(power_watts)),
    bins AS (SELECT hostname, gpu_type, least(255, CAST(floor((power_watts - mn) / (mx - mn) * 256) AS INTEGER)) AS bin,
        count(*) AS c, avg(power_watts) AS x FROM timed JOIN shape USING (hostname, gpu_type) GROUP BY ALL),
    places AS (SELECT *, mn - 2 * h + (mx - mn + 4 * h) * point / 99.0::DOUBLE AS power FROM shape, (SELECT unnest(range(100)) AS point))
    SELECT hostname, gpu_type, point, power, sum(c * exp(-0.5::DOUBLE * ((power - x) / h) ** 2)) / any_value(n * h) / sqrt(2 * pi()) AS density
    FROM places JOIN bins USING (hostname, gpu_type) GROUP BY ALL""",
    d="power density", i="point", with_="timed",
)
# The replicates as rows, weighted by the same digests.
add(
    "timeline_band", lambda s, f: stats.timeline_band(tel(s, f)),
    f"""WITH drawn AS (SELECT hostname, time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket, power_watts, r,
        CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|' || CAST(r // 8 AS VARCHAR)), CAST(4 * (r % 8) + 1 AS BIGINT), 4) AS INTEGER) AS draw
        FROM tel, (SELECT unnest(range(100)) AS r)),
    means AS (SELECT hostname, bucket, r, sum(power_watts * w) / sum(w) AS m FROM
        (SELECT *, {" + ".join(f"CAST(draw >= {c} AS INTEGER)" for c in stats.POISSON)} AS w FROM drawn) GROUP BY ALL HAVING sum(w) > 0),
    plain AS (SELECT hostname, time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket, avg(power_watts) AS avg_power, count(*) AS n FROM tel GROUP BY ALL),
    band AS (SELECT hostname, bucket, quantile_cont(m, 0.025::DOUBLE) AS band_low, quantile_cont(m, 0.975::DOUBLE) AS band_high FROM means GROUP BY ALL)
    SELECT hostname, bucket, avg_power, n, band_low, band_high FROM plain LEFT JOIN band USING (hostname, bucket)""",
    d="avg_power band_low band_high", i="n", t="bucket", with_="tel",
)
add(
    "cluster_scatter", lambda s, f: stats.cluster_scatter(redc(s, f)),
    "SELECT cluster, hour, CAST(floor(power_watts / 10) AS INTEGER) AS power_bin, count(*) AS n FROM redc GROUP BY ALL",
    i="cluster hour power_bin n", with_="redc",
)
add(
    "behavior_scatter", lambda s, f: stats.behavior_scatter(lab(s, f)),
    """SELECT behavior_label, CAST(floor(power_watts / 20) AS INTEGER) AS power_bin, CAST(floor(rolling_mean_power / 20) AS INTEGER) AS rolling_bin,
    count(*) AS n FROM lab GROUP BY ALL""",
    i="power_bin rolling_bin n", with_="lab",
)

# 120-121, 124
add("union_stats", lambda s, f: stats.union_stats(node(s, f), red(s, f)), f"{NSTATS} UNION ALL {GSTATS}", d="mean variance std_dev", with_="node red")
add("distinct_keys", lambda s, f: readers.distinct_keys(tel(s, f), GPU_KEYS), "SELECT DISTINCT hostname, pci_bus_id FROM tel", with_="tel")
add(
    "sample_n", lambda s, f: sample_n(tel(s, f), "row_id", 1000).select("row_id", "power_watts"),
    f"SELECT row_id, power_watts FROM {SAMPLE.format(t='tel', n=1000)}", d="power_watts", i="row_id", with_="tel",
)


# The reports of the labelled table, from one scan with grouping sets
@stored
def facts(s, f):
    return reports.report_facts(lab(s, f))


def class_rows(rule: str, name: str) -> str:
    return f"""SELECT gpu_id AS key, c AS value FROM (SELECT gpu_id, {CLASS.format(10, 5, rule)} AS c FROM ({PROFILE}))
    WHERE c = '{name}' ORDER BY gpu_id LIMIT 5"""


BY_TYPE = f"SELECT 'load_by_gpu_type' AS section, gpu_type AS key, {FIXED.format('avg(power_watts)')} AS value FROM lab GROUP BY gpu_type"
HOST = f"SELECT '{{0}}' AS section, h AS key, {FIXED.format('p')} AS value FROM (SELECT hostname AS h, avg(power_watts) AS p FROM lab GROUP BY hostname ORDER BY {{1}}, h LIMIT 1)"
V2_LABEL = """CASE WHEN avg_power < 100 AND power_var < 500 THEN 'Idle/Low Load' WHEN avg_power < 150 AND power_var < 1000 THEN 'Moderate Load'
    WHEN avg_power >= 150 AND power_var < 2000 THEN 'High Load' ELSE 'Burst/Unstable' END"""
EXTREME = "OR pct_time_extreme_load > 10"
add(
    "report_deep", lambda s, f: reports.deep_report(facts(s, f), 0.161),
    f"""SELECT 'parameters' AS section, 'epsilon' AS key, '0.1610' AS value
    UNION ALL SELECT 'cluster_interpretation', cluster || ' ' || {V2_LABEL}, {FIXED.format("avg_power")} || ' ' || {FIXED.format("power_var")} || ' ' || point_count FROM stats
    UNION ALL SELECT 'outlier_types', outlier_type, CAST(count(*) AS VARCHAR) FROM lab WHERE cluster = -1 GROUP BY outlier_type
    UNION ALL SELECT 'gpu_classes', k, CAST(count(c) AS VARCHAR) FROM (VALUES ('Stable'), ('High-Load Consistent'), ('Unstable / Spiky')) v(k)
        LEFT JOIN (SELECT {CLASS.format(10, 5, "")} AS c FROM ({PROFILE})) ON k = c GROUP BY k
    UNION ALL SELECT 'unstable_gpus', key, value FROM ({class_rows("", "Unstable / Spiky")})
    UNION ALL {BY_TYPE} UNION ALL {HOST.format("top_node", "p DESC")} UNION ALL {HOST.format("least_node", "p")}""",
    with_="lab stats",
)
add(
    "report_final", lambda s, f: reports.final_report(facts(s, f), 0.161),
    f"""SELECT 'parameters' AS section, 'epsilon' AS key, '0.1610' AS value
    UNION ALL SELECT 'clusters', 'n_clusters', CAST(count(*) AS VARCHAR) FROM stats
    UNION ALL SELECT 'noise_pct', 'outlier_pct', {FIXED.format("avg(CASE WHEN cluster = -1 THEN 100.0::DOUBLE ELSE 0 END)")} FROM lab
    UNION ALL SELECT 'inliers_pct', CASE WHEN is_peak = 1 THEN 'Peak' ELSE 'Non-Peak' END,
        {FIXED.format("avg(CASE WHEN behavior_label IS NOT DISTINCT FROM 'Spike Event' THEN 0 ELSE 100.0::DOUBLE END)")} FROM lab GROUP BY is_peak
    UNION ALL SELECT 'cluster_interpretation', cluster || ' ' || behavior_label, {FIXED.format("avg_power")} || ' ' ||
        {FIXED.format("point_count * 100.0::DOUBLE / (SELECT count(*) FROM lab)")} FROM slab
    UNION ALL (SELECT 'outlier_hours', CAST(hour AS VARCHAR), CAST(count(*) AS VARCHAR) FROM lab WHERE cluster = -1 GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 3)
    UNION ALL {BY_TYPE}
    UNION ALL SELECT 'high_load_gpus', key, value FROM ({class_rows(EXTREME, "High-Load Consistent")})
    UNION ALL SELECT 'investigate', key, value FROM ({class_rows(EXTREME, "Unstable / Spiky")})
    UNION ALL {HOST.format("balance_from", "p DESC")} UNION ALL {HOST.format("balance_to", "p")}""",
    with_="lab slab",
)
add(
    "report_final_json", lambda s, f: reports.final_report_json(facts(s, f), 0.161),
    f"""SELECT CAST(json_object('clustering_radius', 0.161::DOUBLE,
    'clustering_performance', json_object('full_clusters', (SELECT count(*) FROM stats),
        'outlier_pct', (SELECT {NUMBER.format("avg(CASE WHEN cluster = -1 THEN 100.0::DOUBLE ELSE 0 END)")} FROM lab)),
    'actionable_insights', json_object('inspect', (SELECT to_json(coalesce(list(key ORDER BY key), [])) FROM ({class_rows(EXTREME, "Unstable / Spiky")})),
        'balance', json_object('from', (SELECT key FROM ({HOST.format("x", "p DESC")})), 'to', (SELECT key FROM ({HOST.format("x", "p")}))))
    ) AS VARCHAR) AS report""",
    with_="lab stats",
)
add(
    "report_patterns", lambda s, f: reports.pattern_report(redc(s, f)),
    f"""WITH spk AS MATERIALIZED (SELECT * FROM redc WHERE power_watts >= (SELECT quantile_cont(power_watts, 0.75::DOUBLE) FROM redc)),
    b AS MATERIALIZED (SELECT *, {BAND} AS time_band FROM redc), c AS MATERIALIZED ({CV})
    (SELECT 'spike_hours' AS section, CAST(hour AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value FROM spk GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 5)
    UNION ALL SELECT 'recurring_hours', CAST(hour AS VARCHAR), CAST(count(DISTINCT date) AS VARCHAR) FROM spk GROUP BY hour
        HAVING count(DISTINCT date) >= 0.5 * (SELECT count(DISTINCT date) FROM redt)
    UNION ALL SELECT 'band_dominance', time_band, modal_cluster || ' ' || {FIXED.format("p")} FROM (SELECT time_band, avg(power_watts) AS p FROM b GROUP BY time_band)
        JOIN {MODE.format(k='time_band', c='cluster', t='b')} USING (time_band)
    UNION ALL SELECT 'day_dominance', CAST(date AS VARCHAR), modal_cluster || ' ' || {FIXED.format("p")} FROM (SELECT date, avg(power_watts) AS p FROM redc GROUP BY date)
        JOIN {MODE.format(k='date', c='cluster', t='redc')} USING (date)
    UNION ALL SELECT 'state_share', state, {FIXED.format("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM state)")} FROM state GROUP BY state
    UNION ALL SELECT 'burstiness', CAST(hour AS VARCHAR), CASE WHEN cv > (SELECT median(cv) FROM c) THEN 'bursty' ELSE 'balanced' END FROM c WHERE cv IS NOT NULL
    UNION ALL SELECT 'overall', CASE WHEN cv > 0.5 THEN 'BURSTY' ELSE 'BALANCED' END, {FIXED.format("cv")}
        FROM (SELECT stddev_samp(power_watts) / avg(power_watts) AS cv FROM redt)
    UNION ALL SELECT 'host_states', hostname, {FIXED.format("avg(CASE WHEN state = 'Idle' THEN 100.0::DOUBLE ELSE 0 END)")} || ' ' ||
        {FIXED.format("avg(CASE WHEN state = 'Active' THEN 100.0::DOUBLE ELSE 0 END)")} FROM state GROUP BY hostname""",
    with_="redc state",
)
