"""Incremental forms: downsampling, features with device state, and flagging."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattspark.operators.common import attach_one_row, scratch_path
from wattspark.operators.features import power_features
from wattspark.schema import GPU_KEYS, POWER


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_and_read(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a new shared folder and read the result back."""
    path = scratch_path(spark, name)
    run_to_parquet(stream, path, f"{path}-state")
    return spark.read.schema(stream.schema).parquet(path)


def run_latest(spark: SparkSession, stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream to the end of its input and read the latest value of every group.

    Every micro-batch stores the groups it changed, so groups that are still open when the input ends
    are part of the result; a batch that is tried again replaces its own folder.
    """
    path = scratch_path(spark, name)

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{path}-state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    stored = spark.read.schema(schema).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return stored.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def stream_gpu_downsample(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean and sum per device and interval; readings later than the watermark are dropped."""
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("timestamp", delay)
        .groupBy(*GPU_KEYS, F.window("timestamp", width).alias("w"))
        .agg(F.avg(POWER).alias(POWER), F.sum(POWER).alias("power_sum"), F.count(F.lit(1)).alias("n"))
        .select(*GPU_KEYS, F.col("w.start").alias("timestamp"), POWER, "power_sum", "n")
    )


_READING = T.StructType(
    [
        T.StructField("gpu_id", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(POWER, T.DoubleType()),
    ]
)
_HELD = T.StructType([f for f in _READING.fields if f.name != "gpu_id"])


class _Piece(StatefulProcessor):
    """Holds the readings of one device and time piece until the watermark has passed the piece's end.

    Then they leave in time order, and nothing of the piece stays behind.
    """

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            self.handle.registerTimer((key[1] + 1) * self.width_ms)
        for part in rows:
            part = part[[f.name for f in _HELD.fields]].astype({"timestamp": object})
            self.held.appendList(list(part.itertuples(index=False, name=None)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.held.get(), key=lambda r: (r[1], r[0]))
        self.held.clear()
        yield pd.DataFrame({"gpu_id": key[0], **{f.name: [r[i] for r in rows] for i, f in enumerate(_HELD.fields)}})

    def close(self) -> None:
        pass


def closed_readings(stream: DataFrame, delay: str, piece_seconds: int = 3600) -> DataFrame:
    """The readings of a stream, each time piece of a device at once when no reading of it can come any more.

    State is keyed by device and piece, so a busy device is spread over many groups; a piece's state goes
    when the watermark (the latest reading less `delay`) passes its end. Readings that come later than the
    watermark are dropped, and so are those without a timestamp.
    """
    rows = stream.select(
        F.concat("hostname", F.lit("_"), "pci_bus_id").alias("gpu_id"),
        "row_id",
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        POWER,
    ).where("timestamp IS NOT NULL")
    piece = F.floor(F.unix_seconds("timestamp") / piece_seconds).alias("_piece")
    timed = rows.withWatermark("timestamp", delay).select("*", piece)
    return timed.groupBy("gpu_id", "_piece").transformWithStateInPandas(_Piece(piece_seconds * 1000), _READING, "append", "eventTime")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_features(
    stream: DataFrame, path: str, delay: str = "1 hour", n: int = 5, piece_seconds: int = 3600, idle: str | None = None
) -> DataFrame:
    """Rolling mean and step change per device in event time: processes what is available, and reads the result.

    Readings may arrive in any order within `delay`; the result equals the batch form over all readings whose
    time piece is closed. Every micro-batch takes the pieces it closes and each device's last n - 1
    closed readings before them (`carry`), and computes the features as the batch form does. Both are stored
    below `path`, next to the stream's checkpoint, so a later run goes on where this one stopped, and a batch
    that is tried again replaces its own folders. With `idle` (an interval) a device leaves the carried
    readings at the end of a batch when it has been silent for so long before the newest reading that the
    batch closed; in later batches it begins anew.
    """
    spark = stream.sparkSession
    columns = [f.name for f in _READING.fields]
    out = f"{path}/features"

    def save(closed: DataFrame, batch: int) -> None:
        work = f"{path}/work-{batch % 2}"
        closed.write.mode("overwrite").parquet(f"{work}/closed")
        new = spark.read.schema(_READING).parquet(f"{work}/closed")
        before = f"{path}/work-{(batch - 1) % 2}/carry"
        old = spark.read.schema(_READING).parquet(before) if batch else spark.createDataFrame([], _READING)
        both = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
        made = power_features(both, ["gpu_id"], POWER, n).where(~F.col("_old")).drop("_old")
        made.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        newest = Window.partitionBy("gpu_id").orderBy(F.desc("timestamp"), F.desc("row_id"))
        last = both.select(*columns, F.row_number().over(newest).alias("_rn")).where(F.col("_rn") < n).drop("_rn")
        if idle:
            end = new.agg(F.max("timestamp").alias("_end"))
            last = attach_one_row(last, end).where(F.col("_end").isNull() | (F.col("timestamp") >= F.col("_end") - F.expr(f"INTERVAL {idle}"))).drop("_end")
        last.write.mode("overwrite").parquet(f"{work}/carry")

    set_before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)  # timers and list state need it
    try:
        query = (
            closed_readings(stream, delay, piece_seconds)
            .writeStream.foreachBatch(save)
            .option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, set_before)
    kinds = [*_READING.fields, T.StructField("rolling_mean_power", T.DoubleType()), T.StructField("power_delta", T.DoubleType())]
    return spark.read.schema(T.StructType(kinds)).parquet(out).select([f.name for f in kinds])


def stream_iqr_flag(stream: DataFrame, fences: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mark readings outside known fences; the static side is a settled per-device table."""
    keys = keys or GPU_KEYS
    joined = stream.join(fences.select(*keys, "lower", "upper"), keys, "left")
    outside = (F.col(POWER) < F.col("lower")) | (F.col(POWER) > F.col("upper"))
    return joined.withColumn("is_outlier", F.coalesce(outside, F.lit(False)).cast("int")).drop(
        "lower", "upper"
    )
