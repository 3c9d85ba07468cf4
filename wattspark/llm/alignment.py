"""Cross-tokenizer alignment through inverted pair bitmaps.

Every text is encoded by two tokenizers, A (a byte-level BPE file of the tokenizers library) and B (a
sentencepiece model). Both sequences spell the same bytes; the byte offsets where tokens of both end cut
them into groups, and every A token is linked with every B token of its group.

The links are kept as an inverted index. Documents are numbered within segments of a task's rows, and for
every pair of ids a segment has compressed bitmaps of its documents: plane 0 marks the documents that hold
the pair linked, and plane j > 0 those whose number of links of the pair, less one, has bit j - 1. A bitmap
is a sorted list of 16-bit positions or, where that is shorter, a plain bit set. Bitmaps of one pair are
OR-merged within a segment; those of different segments are disjoint, so their popcounts add up:
the sum of plane 0 is the pair's document count, and the planes weighted by their place give its links.
Only popcounts are shuffled for the counts.

Scores return along the postings: each bitmap meets its pair's count, and the count is spread to the
marked documents of the segment, weighted by the planes. A segment has at most `SEGMENT` postings, or one
document, so no task holds more at once, however frequent a pair is.

Defined cases: null and empty texts, and texts whose tokens do not spell the text (unknown or normalised
characters), have no tokens and give zeros and an empty digest; repeated rows each count as a document of
their own; null and repeated keys are kept as they are; an empty table gives an empty result; very long texts
are encoded whole, their links formed in slices; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.bpe import PATTERN
from wattspark.llm.common import give_back
from wattspark.operators.common import settle

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
from tokenizers import Tokenizer  # noqa: E402

ID_BITS, POS_BITS = 20, 16
SEGMENT = 2_000_000  # postings of a segment
BLOCK_CHARS = 1_000_000  # of texts encoded at once
SLICE = 4_000_000  # links formed at once
ROWS = 1 << 16  # of an Arrow batch written


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """Bytes of the tokens of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ahead = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.starts[ids] - ahead, sizes) + np.arange(int(sizes.sum()))].tobytes()


def _by_rank(file: dict) -> tiktoken.Encoding | None:
    """A faster encoder with the same ids, for a plain byte-level file whose merges stand in the order of their ids.

    The lowest rank first is then the first merge first. None for any other file.
    """
    model, split = file["model"], file["pre_tokenizer"] or {}
    vocabulary = {name: i for name, i in model["vocab"].items() if name not in {t["content"] for t in file["added_tokens"]}}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ordered = len(vocabulary) == 256 + len(pairs) and all(vocabulary[x + y] == 256 + k for k, (x, y) in enumerate(pairs))
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file["normalizer"]
    if not ordered or not plain or model.get("dropout"):
        return None
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in name): i for name, i in vocabulary.items()}
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranked = _by_rank(json.loads(a))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet, names = byte_alphabet(), self.a.get_vocab(True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in name)
        self.spell_a = Spelling(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spell_b = Spelling([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if max(len(tokens), len(pieces)) >= 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for the pair keys")
        self.words = max(len(tokens), len(pieces))
        # The text of an id with each mark that may follow it.
        self.written = np.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.words)], object)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text the four numbers (n_a, n_b, n_groups, n_links) and its digest; of all texts the
        sorted keys pair << POS_BITS | place in `texts`, and how many links each stands for."""
        spelt = [(" " + t).encode() for t in texts]
        a = self._encode_a(texts)
        b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]
        none = np.empty(0, np.int64)
        for i, (t, want) in enumerate(zip(texts, spelt)):
            if not t or self.spell_a.join(a[i]) != want or self.spell_b.join(b[i]) != want:
                a[i], b[i], spelt[i] = none, none, b""
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        flat_a, flat_b = (np.concatenate([none, *x]) for x in (a, b))
        numbers = np.zeros((4, len(texts)), np.int64)
        numbers[0], numbers[1] = n_a, n_b
        digests = [""] * len(texts)
        if not len(flat_a):
            return numbers, digests, np.empty(0, np.int64), np.empty(0, np.int64)
        end_a, end_b = np.cumsum(self.spell_a.sizes[flat_a]), np.cumsum(self.spell_b.sizes[flat_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        doc = np.searchsorted(np.cumsum([len(x) for x in spelt]), cuts)  # of each group
        numbers[2] = np.bincount(doc, minlength=len(texts))
        np.add.at(numbers[3], doc, in_a * in_b)
        self._digests(flat_a, flat_b, group_a, group_b, in_a, in_b, n_a + n_b, digests)
        keys, counts = self._links(flat_a, flat_b, group_a, in_a, in_b, doc)
        return numbers, digests, keys, counts

    def _encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by A of each text behind a space."""
        if self.ranked is None:
            return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [np.array(self.ranked.encode_ordinary(" " + t), np.int64) for t in texts]

    def _digests(self, flat_a, flat_b, group_a, group_b, in_a, in_b, sizes, digests) -> None:
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        mixed = np.empty(len(flat_a) + len(flat_b), np.int64)
        i, j = np.arange(len(flat_a)), np.arange(len(flat_b))
        last_a, last_b = i == first_a[group_a] + in_a[group_a] - 1, j == first_b[group_b] + in_b[group_b] - 1
        mixed[i + first_b[group_a]] = flat_a + self.words * last_a
        mixed[j + first_a[group_b] + in_a[group_b]] = flat_b + 2 * self.words * last_b
        ends = np.cumsum(sizes)
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            if size:
                digests[k] = hashlib.sha256(b"".join(self.written[mixed[end - size : end]].tolist())[:-1]).hexdigest()

    def _links(self, flat_a, flat_b, group_a, in_a, in_b, doc) -> tuple[np.ndarray, np.ndarray]:
        first_b = np.cumsum(in_b) - in_b
        partners = in_b[group_a]
        reached = np.cumsum(partners)
        parts, start = [], 0
        while start < len(flat_a):
            before = int(reached[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(reached, before + SLICE, "right")))
            n = partners[start:stop]
            ahead = np.cumsum(n) - n
            other = np.repeat(first_b[group_a[start:stop]] - ahead, n) + np.arange(int(n.sum()))
            pair = np.repeat(flat_a[start:stop], n) << ID_BITS | flat_b[other]
            keys = np.sort(pair << POS_BITS | np.repeat(doc[group_a[start:stop]], n))
            parts.append(_counted(keys, np.ones(len(keys), np.int64)))
            start = stop
        return parts[0] if len(parts) == 1 else or_merge(parts)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, with the sums of their counts."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def or_merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of posting sets; links of a posting found in several sets are added."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.int64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    return _counted(keys[order], counts[order])


def planes(keys: np.ndarray, counts: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """The bitmaps of a segment of `docs` documents: plane, pairs, popcounts and compressed bitmaps."""
    more, plane, marked = counts - 1, 0, np.ones(len(keys), bool)
    while True:
        held = keys[marked]
        if len(held):
            pairs = held >> POS_BITS
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            n = np.diff(np.r_[first, len(held)])
            yield plane, pairs[first], n, compress((held & (1 << POS_BITS) - 1).astype(np.uint16), n, docs)
        if not (more >> plane).any():
            return
        marked = (more >> plane & 1) == 1
        plane += 1


def compress(places: np.ndarray, n: np.ndarray, docs: int) -> pa.Array:
    """Bitmaps of `n` sorted places each: 16-bit places, or a bit set where that is shorter."""
    units = -(-docs // 16)  # of 16 bits, in a bit set
    dense = n > units
    size = np.where(dense, units, n)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    from_ = np.cumsum(n) - n
    thin = ~dense
    ahead = np.cumsum(n[thin]) - n[thin]
    at = np.arange(int(n[thin].sum())) - np.repeat(ahead, n[thin])
    out[np.repeat(ends[thin] - size[thin], n[thin]) + at] = places[np.repeat(from_[thin], n[thin]) + at]
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(units * 16, np.uint8)
        bits[places[from_[k] : from_[k] + n[k]]] = 1
        out[ends[k] - units : ends[k]] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = np.r_[0, ends * 2].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def spread(bitmaps: list[bytes], n: np.ndarray, values: np.ndarray, totals: np.ndarray) -> None:
    """Adds `values` of each bitmap (a row of `values` per result) to its documents in `totals`."""
    thin = np.array([len(x) for x in bitmaps], np.int64) == 2 * n
    places = np.frombuffer(b"".join(x for x, t in zip(bitmaps, thin.tolist()) if t), np.uint16).astype(np.int64)
    for total, value in zip(totals, values):
        np.add.at(total, places, np.repeat(value[thin], n[thin]))
    for k in np.flatnonzero(~thin).tolist():
        marked = np.flatnonzero(np.unpackbits(np.frombuffer(bitmaps[k], np.uint8), bitorder="little"))
        totals[:, marked] += values[:, k : k + 1]


@lru_cache(maxsize=1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


# Of the stored rows, besides the key: where a document or posting belongs, then the columns of each kind.
STORED = "segment bigint, place int, docs int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair bigint, plane int, n bigint, bitmap binary"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
FIELDS = [(name, _KINDS[kind]) for name, kind in (part.split() for part in STORED.split(", "))]


def build_index(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows of two kinds, in one pass over the texts: documents (`plane` null) and postings.

    `a` and `b` are the paths of the tokenizer files, read once on the driver (a few MB, whatever the corpus).
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((_read(a), _read(b)))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    made = f"id {rows.schema['id'].dataType.simpleString()}, {STORED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        base, number = TaskContext.get().partitionId() << 24, 0
        kinds: pa.Schema | None = None

        def batch(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def close() -> Iterator[pa.RecordBatch]:
            segment = base + number
            for plane, pairs, n, bitmaps in planes(*or_merge(parts), size):
                for i in range(0, len(pairs), ROWS):
                    m = len(pairs[i : i + ROWS])
                    yield batch(m, segment=np.full(m, segment), docs=np.full(m, size, np.int32), plane=np.full(m, plane, np.int32), pair=pairs[i : i + ROWS], n=n[i : i + ROWS], bitmap=bitmaps[i : i + ROWS])

        parts, size, held = [], 0, 0
        for given in batches:
            kinds = kinds or pa.schema([("id", given.schema.field("id").type), *FIELDS])
            texts = given.column("t").to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= BLOCK_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                numbers, digests, keys, counts = aligner.align(texts[start:stop])
                if size and (size + stop - start > 1 << POS_BITS or held + len(keys) > SEGMENT):
                    yield from close()
                    parts, size, held, number = [], 0, 0, number + 1
                m = stop - start
                yield batch(m, id=given.column("id")[start:stop], segment=np.full(m, base + number), place=np.arange(size, size + m, dtype=np.int32), groups_sha256=digests, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers)))
                parts.append((keys + size, counts))
                size, held, start = size + m, held + len(keys), stop
                give_back()
        if size:
            yield from close()

    return settle(rows.mapInArrow(run, made))


def pair_counts(index: DataFrame) -> DataFrame:
    """Columns pair, docs (documents that hold the pair linked) and links, from popcounts alone."""
    weight = F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    found = index.where("plane is not null").groupBy("pair")
    return found.agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight).alias("links"))


def scores(index: DataFrame) -> DataFrame:
    """Columns segment, place, n_best, count_sum of the documents that have links."""
    counts = settle(pair_counts(index).withColumn("a", F.shiftrightunsigned("pair", ID_BITS)))
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    judged = counts.join(best, "a").select("pair", F.col("docs").alias("count"), (F.col("docs") == F.col("most")).alias("best"))
    postings = index.where("plane is not null").select("segment", "docs", "pair", "plane", "n", "bitmap")

    def run(group: pa.Table) -> pa.Table:
        docs = group.column("docs")[0].as_py()
        plane = group.column("plane").to_numpy()
        weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0)).astype(np.int64)
        values = np.stack([group.column("best").to_numpy() * weight, group.column("count").to_numpy() * weight])
        totals = np.zeros((2, docs), np.int64)
        spread(group.column("bitmap").to_pylist(), group.column("n").to_numpy(), values, totals)
        place = np.flatnonzero(totals[1])
        out = pa.table([pa.array(np.full(len(place), group.column("segment")[0].as_py())), pa.array(place.astype(np.int32)), *(pa.array(t[place]) for t in totals)], ["segment", "place", "n_best", "count_sum"])
        give_back()
        return out

    return postings.join(judged, "pair").groupBy("segment").applyInArrow(run, "segment bigint, place int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `key`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document.

    `n_best` counts the links whose pair is in as many documents as any pair of the same A id, `count_sum`
    adds the document counts of all links.
    """
    index = build_index(docs, a, b, key, text)
    rows = index.where("plane is null").select("id", "segment", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.join(scores(index), ["segment", "place"], "left")
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
