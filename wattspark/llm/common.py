"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, lengthened until no column of `df` has it (column names ignore case in Spark)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_of(column: str) -> F.Column:
    """The text column for a Python step; null reads as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, so that what one batch needed does not add
    to what the JVM beside it takes. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
