"""Training-order materialisation: token sequences in fixed-stride shards, in a keyed random order.

1. The documents' tokens, each document closed by an end token, are packed into sequences of `length`
   tokens within each input partition. The number of sequences of every partition is known from the
   documents' lengths alone, so a narrow first pass gives each partition its first sequence number.
2. A Feistel network over the next even number of bits, walked along its cycles until the value is
   below the number of sequences, permutes sequence numbers to global slots: a keyed permutation
   that any task evaluates for itself, with no sort and no table of slots.
3. Slots are split into ranges of `per_shard`; a range is one partition, sorted by slot and written
   as one file of equal records. Slot s lies in shard s // per_shard at byte
   (s % per_shard) * length * itemsize, so reading is sequential and resumes at any slot by a seek.

Tokens travel once, in the shuffle to their shard, and each record is compressed for that way. A file appears under its name only when complete,
so tries repeated after a lost executor are harmless. If the layout of the input changes between the
two passes the write stops with an error; `stage=True` stores the tokens first and can't meet this.

Defined cases: null and empty token lists are an end token alone; the last sequence of a partition is
filled up with the pad token; repeated rows are packed as often as they stand; an empty table writes
no shard; ids of any column name or type may identify the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.files import WholeFile, open_folder
from wattspark.operators.common import scratch_path

LENGTH = 1024
PER_SHARD = 16_384
ROUNDS = 6
# Byte ids: the 256 base symbols of byte-level BPE. These two never occur in UTF-8.
BYTE_END, BYTE_PAD = 0xFF, 0xFE


def byte_tokens(docs: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Adds `out`: the text as byte ids, packed one byte an id."""
    return docs.withColumn(out, F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b"")))


def packed_tokens(df: DataFrame, ids: str, out: str = "tokens", dtype: str = "<u2") -> DataFrame:
    """Adds `out`: an array-of-int column of ids, packed as little-endian numbers of `dtype`."""

    @F.arrow_udf(T.BinaryType())
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([x.values.to_numpy(False).astype(dtype).tobytes() if x.is_valid else b"" for x in lists], pa.binary())

    return df.withColumn(out, pack(F.col(f"`{ids}`")))


def _round_keys(key: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """Keyed permutation of 0 .. n-1, evaluated at `numbers`."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> half, x[todo] & low
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & low)
            x[todo] = left << half | right
            todo = todo[x[todo] >= n]
    return x.astype(np.int64)


CHANGED = "the input's partitions changed between the passes; use stage=True"


def write_shards(
    df: DataFrame,
    folder: str,
    key: str,
    doc: str = "doc_id",
    tokens: str = "tokens",
    itemsize: int = 1,
    end: int = BYTE_END,
    pad: int = BYTE_PAD,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    stage: bool = False,
) -> DataFrame:
    """Writes the shards and returns one row per sequence: slot, shard, byte_offset, n_tokens, docs
    (the ids of the documents in it, in order), sha256 of the record."""
    source = df.select(F.col(f"`{doc}`").alias("d"), F.coalesce(F.col(f"`{tokens}`"), F.lit(b"")).alias("t"))
    if stage:
        path = scratch_path(df.sparkSession, "tokens")
        source.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
        source = df.sparkSession.read.schema(source.schema).parquet(path)
    totals = source.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("t") / itemsize + 1).cast("long").alias("n"))
    # One row per input partition.
    counted = {r.p: -(-r.n // length) for r in totals.collect()}
    first: dict[int, int] = {}
    n = 0
    for p in sorted(counted):
        first[p] = n
        n += counted[p]
    spark = df.sparkSession
    doc_type = df.schema[doc].dataType
    starts = spark.sparkContext.broadcast((first, counted, n))
    stride = length * itemsize
    end_bytes, pad_bytes = end.to_bytes(itemsize, "little"), pad.to_bytes(itemsize, "little")
    packed_schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("slot", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("docs", T.ArrayType(doc_type)),
            T.StructField("record", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, counted, n = starts.value
        p = TaskContext.get().partitionId()
        at, last = first.get(p, 0), first.get(p, 0) + counted.get(p, 0)
        held, owners = bytearray(), []
        done: list[tuple[bytes, int, list]] = []
        shrink = zstandard.ZstdCompressor(level=3).compress

        def batch() -> pa.RecordBatch:
            nonlocal at, done
            if at + len(done) > last:
                raise RuntimeError(CHANGED)
            s = slots(np.arange(at, at + len(done)), n, key)
            at += len(done)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(s // per_shard, pa.int32()),
                    pa.array(s, pa.int64()),
                    pa.array([x[1] for x in done], pa.int32()),
                    pa.array([x[2] for x in done], pa.list_(kind)),
                    pa.array([shrink(x[0]) for x in done], pa.binary()),
                ],
                names=packed_schema.names,
            )
            done = []
            return out

        kind = pa.null()
        for b in batches:
            kind = b.schema.field(0).type
            for d, t in zip(b.column(0), b.column(1)):
                value = t.as_py() + end_bytes
                owners.append(d.as_py())
                held += value
                while len(held) >= stride:
                    done.append((bytes(held[:stride]), length, owners))
                    del held[:stride]
                    owners = [d.as_py()] if held else []
                    if len(done) >= 4096:
                        yield batch()
            if done:
                yield batch()
        if held:
            k = len(held) // itemsize
            done.append((bytes(held) + pad_bytes * (length - k), k, owners))
            yield batch()
        if at != last:
            raise RuntimeError(CHANGED)

    shards = max(1, -(-n // per_shard))
    placed = source.mapInArrow(pack, packed_schema).repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    out_schema = T.StructType(
        [
            T.StructField("slot", T.LongType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("byte_offset", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("docs", T.ArrayType(doc_type)),
            T.StructField("sha256", T.StringType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, current = None, -1
        restore = zstandard.ZstdDecompressor().decompress
        # A task writes one shard: every slot of it, in order, or the layout has changed since the count.
        own, (_, _, n) = TaskContext.get().partitionId(), starts.value
        due, last = own * per_shard, min((own + 1) * per_shard, n)
        for b in batches:
            digests = []
            for shard, at, record in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("record")):
                if shard != own or at != due:
                    raise RuntimeError(CHANGED)
                due += 1
                if shard != current:
                    file, current = WholeFile(folder, shard_name(shard)), shard
                data = restore(record.as_py())
                file.write(data)
                digests.append(hashlib.sha256(data).hexdigest())
            slot = b.column("slot")
            yield pa.RecordBatch.from_arrays(
                [
                    slot,
                    b.column("shard"),
                    pa.array(slot.to_numpy(False) % per_shard * stride, pa.int64()),
                    b.column("n_tokens"),
                    b.column("docs"),
                    pa.array(digests, pa.string()),
                ],
                names=out_schema.names,
            )
        if due < last:
            raise RuntimeError(CHANGED)
        if file:
            file.close()

    return placed.mapInArrow(write, out_schema)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def read_slots(folder: str, first: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = "u1") -> Iterator[np.ndarray]:
    """The sequences of `n` slots from `first` on, by one seek and sequential reads per shard."""
    fs, root = open_folder(folder)
    stride = length * np.dtype(dtype).itemsize
    while n > 0:
        shard, row = divmod(first, per_shard)
        rows = min(n, per_shard - row)
        path = f"{root.rstrip('/')}/{shard_name(shard)}"
        if not fs.get_file_info(path).is_file:
            return  # past the last shard
        with fs.open_input_file(path) as f:
            f.seek(row * stride)
            for _ in range(rows):
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield np.frombuffer(data, dtype)
        first, n = first + rows, n - rows


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard files as rows (path, length, content), for checks with Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path", "length", "content")
