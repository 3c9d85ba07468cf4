"""SimHash near-duplicate groups by pivot distance tables.

A document's fingerprint has 64 bits; a bit is set when it is set in more than half of the hashes
of the document's word shingles. Two documents link when their fingerprints differ in at most two
bits, and a group is a connected component of links.

Distinct fingerprints are compared, never documents, so copies cost one row. For every distinct
fingerprint the Hamming distances to `PIVOTS` (65 reference fingerprints) are computed once. The
references are the zero word and, for each of four 16-bit blocks, the 16 rows of a Walsh code laid
into that block. Relative to the distance to the zero word, the 16 distances of a block change only
when a bit of the block differs. Two differing bits touch at most two blocks, so linked fingerprints
share the relative distances of at least two blocks: the six pairs of blocks give six lookup keys
into the table, and every link is found under at least one of them. A candidate pair is discarded
when any of its 65 coordinates differs by more than two (the triangle inequality), and survivors
are verified by counting the bits of their XOR.

A key shared by more than `GROUP` fingerprints (a large group of near copies) is not expanded into
pairs. Each of its members is entered once under itself and its 64 one-bit neighbours; two members
are within two bits exactly when they share such a centre, and all members under a centre are linked
to the smallest of them. That is exact and linear in the members.

Nothing is collected: candidates, links and components are shuffled tables.

Defined cases: null and empty texts have the fingerprint zero and link like any other; texts of one
or two words hash the whole sequence; repeated rows each get a result row; a null id never names a
component (the component of rows without any id is null); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.common import free_name, give_back, text_of
from wattspark.operators.common import settle
from wattspark.operators.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
GROUP = 32  # fingerprints under one key up to which their pairs are candidates
BLOCKS = 4
WIDTH = 64 // BLOCKS


def _pivots() -> np.ndarray:
    """The zero word, then for each block the 16 rows of its Walsh code (row 0 taken as all ones)."""
    rows = []
    for i in range(WIDTH):
        bits = [(i & j).bit_count() & 1 for j in range(WIDTH)] if i else [1] * WIDTH
        rows.append(sum(b << j for j, b in enumerate(bits)))
    return np.array([0] + [row << WIDTH * b for b in range(BLOCKS) for row in rows], np.uint64)


PIVOTS = _pivots()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 200_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), _CHUNK):
        hashes = np.array([digest(s, SEED) for s in shingles[i : i + _CHUNK]], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view("<i8")[0])


def simhash(text: str = "text", size: int = SHINGLE) -> Column:
    """64-bit fingerprint of a whole text, as a signed long."""

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([fingerprint(v.as_py() or b"", size) for v in texts.cast(pa.binary())], pa.int64())
        give_back()
        return out

    return run(text_of(text))


def pivot_table(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Adds `distances`: the Hamming distances of each fingerprint to the pivots, in their order."""

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def distances(values: pa.Array) -> pa.Array:
        x = values.to_numpy(False).astype(np.int64).view(np.uint64)
        d = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        ends = np.arange(0, d.size + 1, len(PIVOTS), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(d.ravel()))

    return prints.withColumn("distances", distances(F.col(fp)))


def _keys(distances: str) -> Column:
    """The six lookup keys: distances of two blocks, relative to the distance to the zero word."""
    d = F.col(distances)
    relative = lambda b: F.transform(F.slice(d, 2 + WIDTH * b, WIDTH), lambda x: x - d[0])
    return F.array(*(F.xxhash64(F.lit(f"{a}{b}"), relative(a), relative(b)) for a, b in combinations(range(BLOCKS), 2)))


def links(prints: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Columns u, v: pairs of distinct fingerprints whose closure is that of all pairs within `max_bits`.

    Pairs under small keys are given as they are; members of a large group are linked through
    the smallest member under each shared centre.
    """
    if max_bits != 2:
        raise ValueError("the lookup keys and centres are made for two bits")
    keyed = settle(pivot_table(prints.select(F.col(fp).alias("fp")).distinct()).select("fp", "distances", F.explode(_keys("distances")).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(keyed.join(sizes, "key"))
    small = shared.where(F.col("n") <= group)
    a = small.select("key", F.col("fp").alias("u"), F.col("distances").alias("du"))
    b = small.select("key", F.col("fp").alias("v"), F.col("distances").alias("dv"))
    apart = F.array_max(F.zip_with("du", "dv", lambda x, y: F.abs(x - y)))
    pairs = (
        a.join(b, "key")
        .where("u < v")
        .where(apart <= max_bits)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
        .select("u", "v")
    )
    members = shared.where(F.col("n") > group).select("fp").distinct()
    centres = settle(
        members.select(
            "fp",
            F.explode(F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))))).alias("centre"),
        )
    )
    least = centres.groupBy("centre").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = centres.join(least, "centre").where("u <> fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(through).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Columns `key`, fp, component_id (the smallest key of the group), one row per document."""
    return _grouped(docs, key, text, size, max_bits).select(key, "fp", "component_id")


def _grouped(docs: DataFrame, key: str, text: str, size: int, max_bits: int, *more: Column) -> DataFrame:
    """Columns `key`, `more`, fp, _comp (the group), component_id, one row per document."""
    marked = settle(docs.select(F.col(f"`{key}`"), simhash(text, size).alias("fp"), *more))
    prints = settle(marked.groupBy("fp").agg(F.min(key).alias("_first")))
    edges = links(prints, "fp", max_bits).select(F.lit(0).alias("run"), "u", "v")
    edges = settle(edges)
    ends = edges.select("run", F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = connected_components(ends, edges).select(F.col("node").alias("fp"), "comp")
    grouped = prints.join(labels, "fp", "left").select("fp", "_first", F.coalesce("comp", "fp").alias("_comp"))
    least = grouped.groupBy("_comp").agg(F.min("_first").alias("component_id"))
    named = settle(grouped.join(least, "_comp").select("fp", "_comp", "component_id"))
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of `docs`: one whose key is the smallest of the group; of repeated rows, one.

    Keys may repeat on rows with different texts, so rows are named by key and text.
    Rows without a key can't be named as a group's representative and stay.
    """
    d, h, r = free_name(docs, "_kept"), free_name(docs, "_text_hash"), free_name(docs, "_row")
    hashed = F.xxhash64(text_of(text))
    found = _grouped(docs, key, text, size, max_bits, hashed.alias("_hash"))
    first = found.where(F.col(key) == F.col("component_id")).groupBy("_comp", key).agg(F.min("_hash").alias("_hash"))
    kept = first.select(F.col(key).alias(d), F.col("_hash").alias(h))
    rows = docs.join(kept, (F.col(f"`{key}`") == F.col(d)) & (hashed == F.col(h)))
    rows = rows.withColumn(r, F.row_number().over(_by(d, h, text))).where(F.col(r) == 1).select(*(f"`{c}`" for c in docs.columns))
    return rows.unionByName(docs.where(F.col(f"`{key}`").isNull()))


def _by(d: str, h: str, text: str):
    from pyspark.sql import Window

    return Window.partitionBy(d, h).orderBy(F.col(f"`{text}`"))
