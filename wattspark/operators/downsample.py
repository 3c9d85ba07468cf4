"""Fixed-interval series per node and per device (partial aggregation before the shuffle)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.schema import GPU_KEYS, POWER

WIDTH = "5 minutes"


def _bucketed(df: DataFrame, keys: list[str], width: str) -> DataFrame:
    bucket = F.window("timestamp", width)["start"].alias("timestamp")
    return df.select(*keys, bucket, POWER)


def gpu_downsample(df: DataFrame, width: str = WIDTH) -> DataFrame:
    """Mean power per device and interval."""
    return (
        _bucketed(df, GPU_KEYS, width)
        .groupBy(*GPU_KEYS, "timestamp")
        .agg(F.avg(POWER).alias(POWER))
    )


def node_downsample(df: DataFrame, width: str = WIDTH, mode: str = "sum") -> DataFrame:
    """Per node and interval: the sum of all readings, or `mean_draw`, the sum of device means."""
    if mode == "mean_draw":
        per_gpu = gpu_downsample(df, width)
        return per_gpu.groupBy("hostname", "timestamp").agg(F.sum(POWER).alias(POWER))
    return (
        _bucketed(df, ["hostname"], width)
        .groupBy("hostname", "timestamp")
        .agg(F.sum(POWER).alias(POWER))
    )


def downsample_sizes(node: DataFrame, gpu: DataFrame) -> DataFrame:
    a = node.agg(F.count(F.lit(1)).alias("node_rows"))
    b = gpu.agg(F.count(F.lit(1)).alias("gpu_rows"))
    return a.crossJoin(F.broadcast(b))


def power_timeline_node(df: DataFrame, width: str = WIDTH) -> DataFrame:
    """Node series in time order within each host (sorted per partition, not globally)."""
    return node_downsample(df, width).repartition("hostname", F.to_date("timestamp")).sortWithinPartitions(
        "hostname", "timestamp"
    )


def power_timeline_gpu(df: DataFrame, width: str = WIDTH) -> DataFrame:
    return gpu_downsample(df, width).repartition(*GPU_KEYS, F.to_date("timestamp")).sortWithinPartitions(
        *GPU_KEYS, "timestamp"
    )
