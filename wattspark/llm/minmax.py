"""Near-duplicate groups by min-max hashing with exact confirmation.

A document's set holds its distinct word shingles, as 64-bit hashes. Under each of `PERMUTATIONS` keyed
permutations of the hashes both the minimum and the maximum of the set are kept, so one evaluation gives
two values of the signature; each value of two sets is equal with a probability of their Jaccard
similarity J. Each band joins six values, of six permutations, into one lookup key: 24 bands of minima and
24 of maxima. Two sets with J = 0.8 share no key with a probability below 1e-6, and sets that share a key
are candidates.

Exact copies (equal sets, by a 128-bit digest) are one class; classes are compared, never documents.
Links between classes are found in two steps, so that a large group is not expanded into its pairs:

* Star rounds: every key names one of its classes as a centre, by an order that changes with the round, and
  the centre is compared with the other classes under the key that are not yet in its component.
* The rest, whole: all pairs of classes that share a key and are still in different components. Pairs that
  fail an exact bound are dropped inside the join, before a row is made: the sizes must agree within the
  similarity, and the parities of the sets' hash buckets (512 bits) may differ in no more places than the
  symmetric difference of two linked sets has elements.

Every remaining pair is confirmed by the intersection of the two full sets. The sets of candidates alone
are made a second time; they are never stored for the whole corpus.

Defined cases: a null text, an empty text or one without words has an empty set and is linked with nothing
(its component is its own id); a text of fewer words than a shingle is one shingle; repeated rows each get a
result row; a null id never names a component (the component of rows without any id is null, and such rows
count as kept); an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import give_back, text_of
from wattspark.operators.common import broadcast_if_small, settle
from wattspark.operators.components import merge_components

PERMUTATIONS, BAND = 144, 6
BANDS = 2 * PERMUTATIONS // BAND
PARITY = 512  # bits
WORDS = PARITY // 64
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i), 13) | 1 for i in range(PERMUTATIONS)], np.uint64)
_MIX = np.array([xxhash.xxh64_intdigest(str(i), 17) | 1 for i in range(BAND)], np.uint64)
_BAND_NUMBER = np.array([xxhash.xxh64_intdigest(str(i), 19) for i in range(BANDS)], np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 512

SKETCH = "struct<n: bigint, sid: binary, keys: array<bigint>, odd: array<bigint>>"


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(words)} if len(words) < size else set(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set (not empty) under each permutation."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        seen = hashes[None, i : i + _CHUNK] * MULTIPLIERS[:, None]  # an odd factor permutes the 64-bit numbers
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    keys = (np.concatenate([low, high]).reshape(BANDS, BAND) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND_NUMBER
    return keys.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each hash bucket, whether it holds an odd number of the set's elements: `WORDS` 64-bit words.

    Two sets' parities differ in no more places than the sets have elements of their own.
    """
    odd = np.bincount((hashes >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(text: str, size: int) -> Column:
    """Size of the set, its digest, the band keys and the parities."""

    @F.arrow_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        n, sid, keys, odd, ends = [], [], [], [], [0]
        for v in texts.cast(pa.binary()):
            hashes = shingle_set(v.as_py() or b"", size)
            n.append(len(hashes))
            sid.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            if len(hashes):
                keys.append(band_keys(*signature(hashes)))
                odd.append(parities(hashes))
            ends.append(len(keys))
        ends = np.array(ends, np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(ends * width), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            for x, width in ((keys, BANDS), (odd, WORDS))
        ]
        out = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sid, pa.binary()), *lists], ["n", "sid", "keys", "odd"])
        give_back()
        return out

    return run(text_of(text))


def _set_of(text: str, size: int) -> Column:
    @F.arrow_udf("struct<sid: binary, elements: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(v.as_py() or b"", size) for v in texts.cast(pa.binary())]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        elements = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
        sid = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        out = pa.StructArray.from_arrays([sid, pa.ListArray.from_arrays(pa.array(ends), elements)], ["sid", "elements"])
        give_back()
        return out

    return run(F.col(text))


class _Classes:
    """Classes of equal sets that share a band key with another class, and what is known of their links."""

    def __init__(self, docs: DataFrame, marked: DataFrame, text: str, size: int, percent: int):
        self.percent = percent
        made = marked.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("tkey").alias("tkey"), F.first("keys").alias("keys"), F.first("odd").alias("odd"))
        # Numbered while it is written, so the numbers are fixed from here on.
        classes = settle(made.withColumn("cid", F.monotonically_increasing_id()))
        self.numbers = classes.select("sid", "cid")
        keyed = classes.select("cid", F.explode("keys").alias("key"))
        several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("in")).where("in > 1").select("key")
        self.shared = settle(keyed.join(several, "key"))
        odd = [F.col("odd")[i].alias(f"o{i}") for i in range(WORDS)]
        self.info = settle(classes.join(self.shared.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "sid", "tkey", *odd))
        wanted = broadcast_if_small(self.info.select("tkey").distinct(), self.info.count())
        texts = docs.select(text_of(text).alias("t")).join(wanted, F.xxhash64("t") == F.col("tkey"), "left_semi").distinct()
        found = texts.select(_set_of("t", size).alias("s")).select("s.sid", "s.elements")
        self.sets = settle(found.join(self.info.select("sid", "cid"), "sid").select("cid", "elements").dropDuplicates(["cid"]))
        self.labels = self.info.select(F.lit(0).alias("run"), F.col("cid").alias("node"), F.col("cid").alias("comp"))

    def _info(self) -> DataFrame:
        return self.info.join(self.labels.select(F.col("node").alias("cid"), "comp"), "cid").drop("sid", "tkey")

    def _sided(self, side: str) -> DataFrame:
        info = self._info()
        return info.select(*(F.col(c).alias(side if c == "cid" else f"{side}_{c}") for c in info.columns))

    def _may_link(self) -> Column:
        """Different components, and no exact bound against the pair (columns u_* and v_*)."""
        p = self.percent
        total = F.col("u_n") + F.col("v_n")
        sizes = 100 * F.least("u_n", "v_n") >= p * F.greatest("u_n", "v_n")
        apart = sum((F.bit_count(F.col(f"u_o{i}").bitwiseXOR(F.col(f"v_o{i}"))).cast("long") for i in range(WORDS)), F.lit(0).cast("long"))
        # A link's symmetric difference is at most (100 - p) / (100 + p) of the two sizes' sum.
        return (F.col("u_comp") != F.col("v_comp")) & sizes & ((100 + p) * apart <= (100 - p) * total)

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs u, v, those whose full sets are similar enough."""
        side = lambda s: self.sets.select(F.col("cid").alias(s), F.col("elements").alias(f"{s}_set"))
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        common = F.size(F.array_intersect("u_set", "v_set")).cast("long")
        whole = F.size("u_set") + F.size("v_set") - common
        return both.where(100 * common >= self.percent * whole).select(F.lit(0).alias("run"), "u", "v")

    def _merge(self, links: DataFrame) -> None:
        self.labels = merge_components(self.labels, links)

    def star(self, order: int) -> tuple[int, int]:
        """One round of centres; how many pairs were compared, and how many are links."""
        centre = self.shared.groupBy("key").agg(F.min(F.col("cid").bitwiseXOR(F.lit(order))).alias("c")).select("key", F.col("c").bitwiseXOR(F.lit(order)).alias("v"))
        pairs = self.shared.join(centre, "key").where("cid <> v").select(F.col("cid").alias("u"), "v").distinct()
        pairs = settle(pairs.join(self._sided("u"), "u").join(self._sided("v"), "v").where(self._may_link()).select("u", "v"))
        links = settle(self._confirm(pairs))
        found = links.count()
        if found:
            self._merge(links)
        return pairs.count(), found

    def rest(self) -> None:
        """Compares all pairs under a key that are still in different components."""
        comps = self.labels.select(F.col("node").alias("cid"), "comp")
        placed = self.shared.join(comps, "cid")
        undecided = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        rows = settle(self.shared.join(undecided, "key").join(self._info(), "cid"))
        side = lambda s: rows.select("key", *(F.col(c).alias(s if c == "cid" else f"{s}_{c}") for c in rows.columns if c != "key"))
        u, v = side("u"), side("v")
        pairs = u.join(v, (u["key"] == v["key"]) & (F.col("u") < F.col("v")) & self._may_link()).select("u", "v").distinct()
        links = settle(self._confirm(settle(pairs)))
        if not links.isEmpty():
            self._merge(links)


# Orders of the star rounds; any numbers do.
ORDERS = [0, *(xxhash.xxh64_intdigest(str(i), 23) >> 2 for i in range(1, 32))]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, rounds: int = 4) -> DataFrame:
    """Columns `key`, n_shingles, component_id, kept: one row per document.

    Documents link when 100 * intersection >= `percent` * union of their shingle sets; a group is a
    connected component of links, named by its smallest `key`. `rounds` star rounds at most are made (fewer
    once a round finds few links); they save work and change nothing in the result.
    """
    whole = text_of(text)
    marked = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(whole).alias("tkey"), sketch(text, size).alias("s"))
    marked = settle(marked.select("id", "tkey", "s.*"))
    classes = _Classes(docs, marked, text, size, percent)
    for order in ORDERS[:rounds]:
        compared, links = classes.star(order)
        if 10 * links < compared or not compared:
            break
    classes.rest()
    comps = classes.numbers.join(classes.labels.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    comps = comps.select("sid", F.coalesce("comp", "cid").alias("comp"))
    first = marked.where("n > 0").groupBy("sid").agg(F.min("id").alias("first"))
    placed = settle(first.join(comps, "sid"))
    least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "comp").select("sid", "component_id")
    out = marked.select("id", "n", "sid").join(settle(named), "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
