"""Reading raw and reduced tables, and the adapter from an event log."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.operators.clean import clean_headers, drop_invalid
from wattspark.schema import GPU_KEYS, POWER, RAW


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as text columns under their own headers, whatever the order of columns in each file.

    A plain scan takes the header of one file for all of them and goes by position. Here files are
    grouped by their header line and each group is read with it. With several files this costs one
    pass over the lines at the start of files (no parsing); one file is read as it is.
    """
    plain = spark.read.option("header", True).csv(path)
    files = plain.inputFiles()
    if len(files) < 2:
        return plain
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block")
    )
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()
    parts = [spark.read.option("header", True).option("enforceSchema", False).csv(g.files) for g in groups]
    parts = [clean_headers(p) for p in parts if p.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_power_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """Raw CSV scan, columns matched by the header name of every file; nothing is inferred.

    A name that no file has is an error; a name that some files lack is null in their rows.
    """
    text = clean_headers(_scan_csv(spark, path))
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"no file in {path} has the columns {missing}")
    return _typed(text, schema)


def read_power(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_power_csv(spark, path)
    return clean_headers(spark.read.format(fmt).load(path))


def scan_projected(spark: SparkSession, path: str, cols: list[str], fmt: str = "csv") -> DataFrame:
    """Scan only `cols`; if a name differs, all columns are returned."""
    df = clean_headers(_scan_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path))
    wanted = cols if set(cols) <= set(df.columns) else df.columns
    known = {f.name: f.dataType for f in RAW.fields}
    return df.select(
        *[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in wanted]
    )


def chunked_ingest(
    spark: SparkSession, directory: str, schema: T.StructType, max_files: int = 1000, fmt: str = "csv"
) -> DataFrame:
    """Stream over a directory, with at most `max_files` files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        # Columns go by position; a file whose header does not fit the schema fails the stream instead
        # of filling the wrong columns.
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(directory)


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Has a write to `path` been committed? The marker is looked up on the path's own file system."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def read_stored(spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A stored Parquet table; values of partition columns come back as the text they were ("007")."""
    df = spark.read.parquet(path)
    if not partition_by:
        return df
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in partition_by else f.dataType) for f in df.schema.fields]
    )
    return spark.read.schema(schema).parquet(path)


def reuse_reduced(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = ("hostname",),
) -> DataFrame:
    """Read the stored table; when no complete one is there, build, store and read it."""
    if not _is_complete(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return read_stored(spark, path, partition_by)


def read_reduced(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored reduced table with typed time and power, without empty rows; other columns stay as
    they are stored."""
    df = clean_headers(_scan_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path))
    types = {"timestamp": "timestamp_ntz", POWER: "double"}
    return drop_invalid(
        df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]),
        ["timestamp", POWER],
    )


def recluster_input(df: DataFrame) -> DataFrame:
    """A clustered table made ready to be clustered again."""
    return df.drop("cluster")


def count_readings(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def dataset_summary(df: DataFrame, ts: str = "timestamp", exact: bool = True) -> DataFrame:
    """Rows, distinct hosts and bus ids, first and last elapsed day."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    span = F.extract(F.lit("DAY"), F.max(ts) - F.min(ts))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct(F.col("hostname")).alias("n_hosts"),
        distinct(F.col("pci_bus_id")).alias("n_bus_ids"),
        F.lit(1).alias("first_day"),
        (span + 1).cast("int").alias("last_day"),
    )


# Of the stored sketches: 2**12 registers, so a standard error of 1.04 / 64 for large counts; small ones are exact.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_sketches(df: DataFrame, columns: list[str], ts: str = "timestamp") -> DataFrame:
    """Per calendar day: rows, first and last reading, and a mergeable distinct-count sketch of each column.

    Stored once (and appended to day by day), it answers `range_summaries` without the readings. Rows without
    a timestamp are left out; NULL values of a column are not counted.
    """
    sketches = [F.hll_sketch_agg(c, SKETCH_BITS).alias(f"sketch_{c}") for c in columns]
    spans = [F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last")]
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date")).agg(*spans, *sketches)


def range_summaries(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per range (columns name, from, to; both days included): rows, first and last reading, and an estimate
    `n_<column>` of each column's distinct values, all from the merged daily sketches."""
    columns = [c.removeprefix("sketch_") for c in sketches.columns if c.startswith("sketch_")]
    inside = sketches.join(ranges, F.col("date").between(F.col("from"), F.col("to")))
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"n_{c}") for c in columns]
    return inside.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"), *counts)


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Readings made from an event log: users are spread over ten hosts, event types are slots."""
    host = F.col("user_id") % 10
    return events.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("node"), F.lpad(host.cast("string"), 2, "0")).alias("hostname"),
        F.when(host < 4, "NVIDIA A100-SXM4-40GB")
        .otherwise("NVIDIA H100 80GB HBM3")
        .alias("gpu_name"),
        F.col("event_type").alias("pci_bus_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        (F.col("value") * 2.0).alias(POWER),
    )


def read_events(spark: SparkSession, directory: str) -> DataFrame:
    return telemetry_from_events(spark.read.parquet(f"{directory}/events.parquet"))


def reading_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a text key for reduced rows, which have one row per device and bucket."""
    return df.withColumn(
        name, F.concat_ws("|", *GPU_KEYS, F.date_format("timestamp", "yyyyMMddHHmmss"))
    )
