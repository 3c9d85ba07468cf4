"""Benchmark decontamination over a distributed positional inverted index.

`build_index` tokenises the training texts once and stores their postings: one row per block of
documents, with the block's terms and, for each term, the ascending positions at which it stands
(documents of a block are laid end to end, each start is stored). Blocks are built where the texts
lie, so no posting is shuffled and no term gathers in one task; a later benchmark searches the
stored index without reading the texts again. Terms and numbers are stored as compressed bytes
(positions by their distances): an executor's JVM only passes them on, and what it holds of a block
is a fraction of its text. Written with the options `STORED`, a reader holds one block at a time.

`search_index` looks the test phrases up in every block: those with a word that the block does not have
leave at once, the others are kept under their rarest word there, and the posting lists of their words,
shifted by their place in the phrase, are intersected from that word on, for many phrases in one array
step. What is left are the exact starts of the phrases. Both phrases and places are taken in steps of
bounded size, and matches stay arrays, however many there are. With `slop` > 0 proximity matches are found as
well: each word may stand up to `slop` positions from its place; the same lists tell the exact ones.

The phrases are broadcast in slices of at most `SLICE_BYTES` of benchmark text, one pass over the
index per slice, so a benchmark of any size keeps bounded tasks.

Defined cases: a null or empty text has no words and no matches; an item without words has no
phrase; an item shorter than the window is one phrase; items of equal text all match; a null item
id counts as the empty string; repeated rows give repeated results; a document longer than a block
has a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.common import free_name, give_back, text_of

WINDOW = 10
BLOCK_WORDS = 1_000_000
WORD_BYTES = 7  # of text, a word with what stands around it
STEP_PLACES = 250_000  # places looked at in one array step
STEP_PHRASES = 50_000  # phrases looked up in one array step
SLICE_BYTES = 8_000_000
STORED = {"parquet.block.row.count.limit": "1"}  # a row of the index is a row group

# Words are runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("exact", T.BooleanType()),
    ]
)
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Phrases:
    """The distinct phrases of some items, as rows of term numbers, and the items each comes from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of = owners.setdefault(tuple(words[i : i + window]), [])
                if item not in of:
                    of.append(item)
        number = {item: i for i, item in enumerate(dict.fromkeys(item for of in owners.values() for item in of))}
        self.items = pa.array(number, pa.string())
        self.owners = np.array([number[item] for of in owners.values() for item in of], np.int32)
        self.first_owner = np.zeros(len(owners) + 1, np.int64)  # owners of a phrase: from here to the next one's
        np.cumsum([len(of) for of in owners.values()], out=self.first_owner[1:])
        self.terms = list(dict.fromkeys(w for p in owners for w in p))
        number = {t: i for i, t in enumerate(self.terms)}
        self.sizes = np.array([len(p) for p in owners], np.int64)
        self.words = np.full((len(owners), int(self.sizes.max(initial=1))), -1, np.int32)  # -1: no word
        for row, p in zip(self.words, owners):
            row[: len(p)] = [number[w] for w in p]


class Postings:
    """The positional postings of one block: term -> ascending positions."""

    def __init__(self, terms: pa.Array, starts: np.ndarray, positions: np.ndarray, doc_starts: np.ndarray):
        self.terms, self.starts, self.positions, self.doc_starts = terms, starts.astype(np.int64), positions, doc_starts

    @classmethod
    def of(cls, texts: pa.Array) -> Postings:
        """Postings of all words of the texts (binary, no nulls)."""
        offsets, data = texts.buffers()[1:]
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        first = int(offsets[0])
        # One byte stays one byte, so the texts keep their places; a word ends with its text.
        plain = bytes(memoryview(data)[first : int(offsets[-1])]).translate(_WORDS) if data is not None else b""
        letters = np.frombuffer(plain, np.uint8) != 32
        before = np.zeros(len(letters), bool)
        before[1:] = letters[:-1]
        edges = offsets.astype(np.int64) - first
        before[edges[:-1][edges[:-1] < len(letters)]] = False
        begins = np.flatnonzero(letters & ~before)
        after = np.zeros(len(letters), bool)
        after[:-1] = letters[1:] & before[1:]
        ends = np.flatnonzero(letters & ~after) + 1
        doc_starts = np.searchsorted(begins, edges).astype(np.int64)
        del letters, before, after
        words = _slices(plain, begins, ends).dictionary_encode()
        del plain, begins, ends
        codes = words.indices.to_numpy(False)
        at = np.argsort(codes, kind="stable").astype(np.int32)
        starts = np.zeros(len(words.dictionary) + 1, np.int64)
        np.cumsum(np.bincount(codes, minlength=len(words.dictionary)), out=starts[1:])
        return cls(words.dictionary, starts, at, doc_starts)

    @classmethod
    def unpacked(cls, n_words: pa.Array, terms: pa.Buffer, term_ends: pa.Buffer, starts: pa.Buffer, positions: pa.Buffer) -> Postings:
        """The postings of a stored block."""
        doc_starts = np.zeros(len(n_words) + 1, np.int64)
        np.cumsum(n_words.to_numpy(False), out=doc_starts[1:])
        ends = unpacked_numbers(term_ends)
        offsets = np.zeros(len(ends) + 1, np.int32)
        offsets[1:] = ends
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), unpacked(terms)])
        return cls(words, unpacked_numbers(starts), unpacked_numbers(positions), doc_starts)

    def candidates(self, phrases: Phrases, here: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases all of whose words stand in the block, the words' terms here, and the order of the words by rarity."""
        words = phrases.words[at]
        word = words >= 0
        term = np.where(word, here[words], -1) if len(here) else words
        held = np.flatnonzero(((term >= 0) | ~word).all(axis=1))
        term, word = term[held].astype(np.int64), word[held]
        counts = np.where(word, np.diff(self.starts)[term], np.iinfo(np.int64).max) if len(held) else term
        return held + at.start, term, np.argsort(counts, axis=1, kind="stable")

    def find(self, phrases: Phrases, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, start in the block, exact) of all places at which every word of a phrase stands within
        `slop` of its own; in pieces of about `STEP_PLACES` places to look at."""
        here = pc.index_in(pa.array(phrases.terms, self.terms.type), self.terms).fill_null(-1).to_numpy(False)
        # Postings as one rising list of numbers: a term's own range, then the position in the block.
        lists = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        lists *= int(self.doc_starts[-1]) + 1
        lists += self.positions
        for first in range(0, len(phrases.sizes), STEP_PHRASES):
            yield from self._find(phrases, slop, lists, *self.candidates(phrases, here, slice(first, first + STEP_PHRASES)))

    def _find(self, phrases: Phrases, slop: int, lists: np.ndarray, held: np.ndarray, term: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(held):
            return
        rarest = term[np.arange(len(held)), order[:, 0]]
        counts = np.diff(self.starts)[rarest]
        width = int(self.doc_starts[-1]) + 1
        step = np.cumsum(counts * (2 * slop + 1)) // STEP_PLACES
        for rows in np.split(np.arange(len(held)), np.flatnonzero(np.diff(step)) + 1):
            n = counts[rows]
            row = np.repeat(rows, n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            starts = self.positions[self.starts[rarest[row]] + within] - order[row, 0]
            if slop:
                # A start near two places of the rarest word counts once.
                moved = (row[:, None] * (width + 4 * (slop + len(order[0]))) + starts[:, None] + 2 * (slop + len(order[0])) + np.arange(-slop, slop + 1)).ravel()
                moved = np.unique(moved)
                row, starts = np.divmod(moved, width + 4 * (slop + len(order[0])))
                starts -= 2 * (slop + len(order[0]))
            size = phrases.sizes[held[row]]
            inside = (starts >= 0) & (starts + size <= self.doc_starts[-1])
            row, starts, size = row[inside], starts[inside], size[inside]
            doc = np.searchsorted(self.doc_starts, starts, "right") - 1
            inside = starts + size <= self.doc_starts[doc + 1]
            row, starts, doc = row[inside], starts[inside], doc[inside]
            exact = np.ones(len(row), bool)
            first, last = self.doc_starts[doc], self.doc_starts[doc + 1] - 1
            for j in range(0 if slop else 1, order.shape[1]):
                if not len(row):
                    break
                k = order[row, j]
                t = term[row, k]
                base = t * width
                i = np.searchsorted(lists, base + np.maximum(starts + k - slop, first))
                near = (i < len(lists)) & (lists[np.minimum(i, len(lists) - 1)] <= base + np.minimum(starts + k + slop, last))
                none = t < 0  # a shorter phrase has no such word
                if slop:
                    i = np.searchsorted(lists, base + starts + k)
                    exact &= none | ((i < len(lists)) & (lists[np.minimum(i, len(lists) - 1)] == base + starts + k))
                near |= none
                row, starts, first, last, exact = row[near], starts[near], first[near], last[near], exact[near]
            if len(row):
                yield held[row], starts, exact

    def matches(self, phrases: Phrases, slop: int) -> pa.Array:
        """For each document of the block the list of its matches, by start."""
        found = [*self.find(phrases, slop)]
        which, starts, exact = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        del found
        # A phrase counts for each of its items; two phrases of an item near one start are one match.
        n = np.diff(phrases.first_owner)[which]
        owner = np.arange(int(n.sum())) + np.repeat(phrases.first_owner[which] - np.cumsum(n) + n, n)
        item, size, starts, exact = phrases.owners[owner], np.repeat(phrases.sizes[which].astype(np.int32), n), np.repeat(starts, n), np.repeat(exact, n)
        del which, owner, n
        order = np.lexsort((size, item, starts))
        item, size, starts, exact = item[order], size[order], starts[order], exact[order]
        new = np.ones(len(order), bool)
        new[1:] = (item[1:] != item[:-1]) | (size[1:] != size[:-1]) | (starts[1:] != starts[:-1])
        first = np.flatnonzero(new)
        exact = np.logical_or.reduceat(exact, first) if len(first) else np.zeros(0, bool)
        item, size, starts = item[first], size[first], starts[first]
        doc = np.searchsorted(self.doc_starts, starts, "right") - 1
        fields = [phrases.items.take(pa.array(item)), pa.array((starts - self.doc_starts[doc]).astype(np.int32)), pa.array(size), pa.array(exact)]
        ends = np.searchsorted(starts, self.doc_starts).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_MATCHES.value_type)), _MATCHES)


def _slices(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces data[begin:end], which rise and leave gaps, as a binary array."""
    sizes = ends - begins
    offsets = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    # Bytes between words are blanks, words have none.
    joined = data.translate(None, b" ")
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined)])


def blocks_of(texts: pa.Array, block_words: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes, at `WORD_BYTES` a word, are about a block; a longer text is its own."""
    sizes = pc.binary_length(texts).to_numpy(False).tolist()
    a, held = 0, 0
    for i, size in enumerate(sizes):
        if i > a and held + size > block_words * WORD_BYTES:
            yield a, i
            a, held = i, 0
        held += size
    if sizes:
        yield a, len(sizes)


_CODEC = pa.Codec("zstd", compression_level=1)


def packed(data: bytes | np.ndarray) -> bytes:
    """Bytes, or rising or small int32 numbers by their distances, compressed behind their size."""
    if isinstance(data, np.ndarray):
        steps = np.diff(data.astype(np.int32), prepend=np.int32(0))
        data = steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of one weight together
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unpacked(data: pa.Buffer) -> pa.Buffer:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"))


def unpacked_numbers(data: pa.Buffer) -> np.ndarray:
    steps = np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
    return np.cumsum(steps, dtype=np.int32, out=steps)


def benchmark_slices(benchmark: DataFrame, item: str, text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in slices whose texts have a measured, bounded size."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), text_of(text).cast("binary").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = -(-total // slice_bytes) if total > slice_bytes else 1
    for k in range(parts):
        yield [(r.i, bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The stored form of the index, as rows of blocks: doc_keys, n_words, and packed: the terms' bytes, where
    each term ends in them, each term's first position in the list, and the list of positions."""
    source = docs.select(F.col(f"`{key}`").alias("k"), text_of(text).cast("binary").alias("t"))
    schema = T.StructType(
        [
            T.StructField("doc_keys", T.ArrayType(docs.schema[key].dataType)),
            T.StructField("n_words", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("term_ends", T.BinaryType()),
            T.StructField("starts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
        ]
    )

    def row(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        p = Postings.of(texts)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        terms, ends = p.terms.to_pylist(), np.cumsum(pc.binary_length(p.terms).to_numpy(False))
        blobs = [packed(x) for x in (b"".join(terms), ends, p.starts, p.positions)]
        return pa.RecordBatch.from_arrays(
            [one(keys), one(pa.array(np.diff(p.doc_starts).astype(np.int32))), *(pa.array([x], pa.binary()) for x in blobs)], names=schema.names
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], names=["k", "t"])
            # Whole batches are gathered up to a block; one larger than a block is cut.
            own = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held and size + own > block_words * WORD_BYTES:
                yield from done(held)
                held, size = [], 0
            held.append(batch)
            size += own
            del batch
            if size >= block_words * WORD_BYTES:
                yield from done(held)
                held, size = [], 0
        yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            keys, texts = (pa.concat_arrays([b.column(c) for b in held]) if len(held) > 1 else held[0].column(c) for c in (0, 1))
            for a, b in blocks_of(texts, block_words):
                yield row(keys[a:b], texts[a:b])
            give_back()

    return source.mapInArrow(blocks, schema)


def _joined(rows: list[pa.Array]) -> pa.Array:
    """Lists side by side, joined row by row."""
    if len(rows) == 1:
        return rows[0]
    turn = np.arange(len(rows) * len(rows[0])).reshape(len(rows), -1).T.ravel()  # row by row, the lists in their order
    lists = pa.concat_arrays(rows).take(pa.array(turn))
    ends = lists.value_lengths().to_numpy(False).reshape(-1, len(rows)).sum(axis=1).cumsum()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), lists.flatten(), _MATCHES)


def _search_texts(phrases: Broadcast, slop: int):
    @F.arrow_udf(T.ArrayType(MATCH))
    def search(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.binary())
        rows = [Postings.of(texts[a:b]).matches(phrases.value, slop) for a, b in blocks_of(texts, BLOCK_WORDS)]
        give_back()
        return pa.concat_arrays(rows) if rows else pa.array([], _MATCHES)

    return search


def search_index(index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per indexed document: doc_key, n_words, matches (item_id, start, length, exact)."""
    spark = index.sparkSession
    parts = [spark.sparkContext.broadcast(Phrases(items, window)) for items in benchmark_slices(benchmark, item, text)]
    schema = T.StructType(
        [
            T.StructField("doc_key", index.schema["doc_keys"].dataType.elementType),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("matches", T.ArrayType(MATCH)),
        ]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n_words, *blobs in zip(*batch.columns):
                block = Postings.unpacked(n_words.values, *(x.as_buffer() for x in blobs))
                yield pa.RecordBatch.from_arrays([keys.values, n_words.values, _joined([block.matches(p.value, slop) for p in parts])], names=schema.names)
                del block
                give_back()
            del batch

    return index.mapInArrow(search, schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """`docs` with the array `out` of its matches, every row judged on its own text.

    The same postings are built for each batch of rows and are not stored; rows need no key and nothing is shuffled.
    """
    spark = docs.sparkSession
    parts = [_search_texts(spark.sparkContext.broadcast(Phrases(items, window)), slop) for items in benchmark_slices(benchmark, item, item_text)]
    found = [part(text_of(text)) for part in parts]
    return docs.withColumn(out, found[0] if len(found) == 1 else F.concat(*found))


def covered_words(matches: Column) -> Column:
    """Number of words inside any match."""
    inside = F.flatten(F.transform(matches, lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))
    return F.size(F.array_distinct(inside)).cast("long")


def matched_items(matches: Column) -> Column:
    """The ids of the matched items, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of `docs` without any match."""
    m = free_name(docs, "_matches")
    return with_matches(docs, benchmark, text, m, **how).where(F.size(m) == 0).drop(m)
