import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.run import TABLES, same
from wattspark.operators.common import qualified, scratch_path
from wattspark.operators.features import power_features
from wattspark.operators.clean import gpu_id
from wattspark.plans.reports import write_tables
from wattspark.schema import POWER
from wattspark.sources import readers
from wattspark.streaming import jobs

SF = "/root/testdata/sf0.001"

# One query per kind of plan; the whole list is compared by `python -m checks.run`.
COMPARED = [
    "read_power_csv", "drop_invalid", "day_number", "gpu_downsample", "all_outliers", "box_stats_node_daily",
    "telemetry_features", "gpu_profile", "timing_pattern", "subset_compare", "spike_heatmap", "report_json",
    "kmeans_det", "dbscan", "stream_gpu_downsample",
]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert same(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["hostname", "pci_bus_id", "timestamp", POWER]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_csv_columns_are_found_by_name(spark):
    path = scratch_path(spark, "csv")
    rows = spark.createDataFrame([(1.5, "h1", "x")], "` power_watts ` double, hostname string, extra string")
    write_tables(rows, path, "csv")
    assert readers.scan_projected(spark, path, ["hostname", "power_watts"]).first() == ("h1", 1.5)
    every = readers.scan_projected(spark, path, ["hostname", "missing"])
    assert set(every.columns) == {"power_watts", "hostname", "extra"}


def test_every_file_is_read_by_its_own_header(spark):
    path = scratch_path(spark, "csv")
    raw = "hostname string, gpu_name string, pci_bus_id string, timestamp string, power_watts double"
    write_tables(spark.createDataFrame([("h", "g", "p", "t", 1.0)], raw), path, "csv")
    other = spark.createDataFrame([(2.0, "t2", "p2", "g2", "h2")], "power_watts double, timestamp string, pci_bus_id string, gpu_name string, hostname string")
    write_tables(other, path, "csv", mode="append")
    got = sorted(tuple(r) for r in readers.read_power_csv(spark, path).collect())
    assert got == [("h", "g", "p", "t", 1.0), ("h2", "g2", "p2", "t2", 2.0)]
    assert sorted(tuple(r) for r in readers.scan_projected(spark, path, ["hostname", "power_watts"]).collect()) == [("h", 1.0), ("h2", 2.0)]
    lacking = scratch_path(spark, "csv")
    write_tables(spark.createDataFrame([("h", 1.0)], "hostname string, power_watts double"), lacking, "csv")
    with pytest.raises(ValueError, match="gpu_name"):
        readers.read_power_csv(spark, lacking)


def test_types_of_stored_tables(spark):
    path = scratch_path(spark, "reduced")
    rows = spark.createDataFrame([("007", 5, 1.5)], "hostname string, hour int, power_watts double")
    for _ in range(2):
        assert readers.reuse_reduced(spark, path, lambda: rows).first().hostname == "007"
    stored = scratch_path(spark, "reduced")
    write_tables(rows.withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), stored)
    assert dict(readers.read_reduced(spark, stored).dtypes)["hour"] == "int"


def test_power_delta_and_pushdown(spark):
    from wattspark.operators.peaks import filter_host

    path = scratch_path(spark, "pq")
    write_tables(readers.read_events(spark, SF), path)
    plan = filter_host(spark.read.parquet(path), "node03").select("timestamp")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(hostname,node03)" in plan


def test_stored_table_is_built_once(spark):
    path, calls = scratch_path(spark, "once"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("h", 1.0)], "hostname string, power_watts double")

    for _ in range(3):
        assert readers.reuse_reduced(spark, path, build).count() == 1
    assert calls == [1]


def shuffled(spark, path, rows, files, jitter_hours):
    """Stores rows file by file in an arrival order up to `jitter_hours` behind their time, then a closing reading."""
    late = F.expr("timestamp + make_interval(0, 0, 0, 0, 0, 0, pmod(row_id * 7919, %d))" % (jitter_hours * 3600))
    arrivals = rows.withColumn("_file", F.ntile(files).over(Window.orderBy(late, "row_id")))
    for i in range(1, files + 1):
        arrivals.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    close(spark, path, rows)


def close(spark, path, rows):
    end = rows.agg(F.max("timestamp").alias("timestamp")).select((F.col("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("timestamp"))
    last = end.select(F.lit(-1).cast("long").alias("row_id"), F.lit("").alias("hostname"), F.lit("").alias("pci_bus_id"), "timestamp", F.lit(0.0).alias(POWER))
    last.coalesce(1).write.mode("append").parquet(path)


def features_of(df):
    out = df.select("row_id", "rolling_mean_power", "power_delta").toPandas()
    return out.sort_values("row_id").round(6).reset_index(drop=True)


def readings(spark):
    return readers.read_events(spark, SF).select("row_id", "hostname", "pci_bus_id", "timestamp", POWER)


@pytest.fixture
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_features_of_shuffled_arrivals_over_many_batches(spark, few_tasks):
    rows = readings(spark).where("row_id % 3 = 0")
    path, work = scratch_path(spark, "in"), scratch_path(spark, "work")
    shuffled(spark, path, rows, 5, 30)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.stream_features(stream, work, "30 hours", piece_seconds=86_400)
    assert features_of(got).equals(features_of(power_features(gpu_id(rows))))
    batches = spark.read.parquet(f"{work}/features").select("batch").distinct().count()
    assert batches >= 4


def test_features_go_on_in_a_later_run_and_idle_devices_leave(spark, few_tasks):
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id, 0, 0, 0)"
    rows = spark.range(12).selectExpr("id AS row_id", "'h' AS hostname", "IF(id % 4 = 0, 'idle', 'busy') AS pci_bus_id", f"CAST({at} AS timestamp_ntz) AS timestamp", f"CAST(id * id AS double) AS {POWER}")
    rows = rows.where("pci_bus_id = 'busy' OR id < 5 OR id = 8".replace("id <", "row_id <").replace("OR id =", "OR row_id ="))
    path, work = scratch_path(spark, "in"), scratch_path(spark, "work")
    for part in ("row_id < 6", "row_id >= 6"):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
        got = jobs.stream_features(spark.readStream.schema(rows.schema).parquet(path), work, "0 seconds", piece_seconds=86_400)
    close(spark, path, rows)
    got = jobs.stream_features(spark.readStream.schema(rows.schema).parquet(path), work, "0 seconds", piece_seconds=86_400)
    assert features_of(got).equals(features_of(power_features(gpu_id(rows))))
    work = scratch_path(spark, "work")
    jobs.stream_features(spark.readStream.schema(rows.schema).parquet(path), work, "0 seconds", piece_seconds=86_400, idle="2 DAYS")
    carried = [{r.gpu_id for r in spark.read.parquet(f"{work}/work-{k}/carry").collect()} for k in (0, 1)]
    assert {"h_busy"} in carried  # the idle one has reported on day 8 of 11


def test_merged_daily_sketches_are_near_the_exact_counts(spark):
    rows = spark.range(60_000).selectExpr("id % 40000 AS v", "timestamp_seconds(1700000000 + id * 13) AS timestamp")
    late = spark.createDataFrame([(7, None)], "v long, timestamp timestamp")
    daily = readers.daily_sketches(rows.union(late), ["v"])
    ranges = spark.createDataFrame([("all", "2000-01-01", "2100-01-01"), ("none", "1990-01-01", "1990-01-02")], "name string, from string, to string")
    found = readers.range_summaries(daily, ranges.selectExpr("name", "CAST(from AS date) AS from", "CAST(to AS date) AS to")).collect()
    assert [r.name for r in found] == ["all"] and found[0].n_rows == 60_000
    assert abs(found[0].n_v - 40_000) <= 4 * readers.SKETCH_ERROR * 40_000
    direct = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("v", readers.SKETCH_BITS))).first()[0]
    assert abs(found[0].n_v - direct) <= 4 * readers.SKETCH_ERROR * 40_000


def test_bare_paths_take_the_file_system_that_spark_reads(spark):
    assert qualified(spark, "/shared/x") == "file:/shared/x"
    assert qualified(spark, "file:///shared/x") == "file:/shared/x"
    assert scratch_path(spark, "x").startswith("file:/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs:///")
    try:
        with pytest.raises(Exception, match="(?i)viewfs"):
            qualified(spark, "/shared/x")  # looked up on the default file system, which has no mounts here
    finally:
        conf.set("fs.defaultFS", old)
