"""Byte-level BPE encoding and decoding by merge replay.

The vocabulary is a rank file: a base64 token and its rank per line. A text is split by the
published pattern; every piece is merged separately, lowest rank first, leftmost first.

Merges never cross a piece, so a corpus can be encoded by replaying the merges over its distinct
pieces. Each task lays the new distinct pieces of a block of its documents end to end as symbols
in a doubly linked list and keeps an inverted index from token pair to the positions of that
pair. Pairs are taken in rising order of rank; a merge touches its own two
symbols and the two neighbours, whose new pairs enter the index. No shuffle is needed, the work
grows with the distinct pieces, and a lost task only repeats its own blocks.

Defined cases: a null or empty text has no ids; repeated rows give repeated results; a piece of
any length is merged whole (the replay is linear in it, but for the heap of ranks).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.common import give_back, text_of

# Fixed value: the split pattern published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BITS = 20  # of a token id, as part of a pair
FREQUENT = 150  # pairs found at so many positions are merged array-wise
BLOCK_BYTES = 4_000_000  # texts of one replay
# White space other than the space and the line feed.
OTHER_SPACE = "\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
UNEVEN = f"  | \\n|\\n |[{OTHER_SPACE}]"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class Replay:
    """Merge replay over sets of distinct pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known = pa.array(list(ranks), pa.binary())
        self.known_ids = np.array(list(ranks.values()), np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that makes a token, as one number -> rank of the merge.
        self.pairs: dict[int, int] = {}
        self.shared: set[int] = set()  # ranks that two overlapping pairs can claim
        for token, rank in ranks.items():
            halves = [(ranks[x], ranks[y]) for i in range(1, len(token)) if (x := token[:i]) in ranks and (y := token[i:]) in ranks]
            self.pairs.update((x << BITS | y, rank) for x, y in halves)
            if {x for x, y in halves if x != y} & {y for x, y in halves if x != y}:
                self.shared.add(rank)
        order = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_ranks = order, np.array([self.pairs[k] for k in order.tolist()], np.int64)

    def _index(self, index: dict[int, list], heap: list[int], at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Enters the pairs at positions `at`; returns the rank of each, or a large number."""
        keys = left.astype(np.int64) << BITS | right
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        real = self.pair_keys[found] == keys
        ranks = np.where(real, self.pair_ranks[found], 1 << BITS)
        entries, at = (ranks << 2 * BITS | keys)[real], at[real]
        order = np.argsort(entries, kind="stable")
        entries, at = entries[order], at[order]
        cuts = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]]).tolist() if len(entries) else []
        # Positions are kept as numbers, or as arrays where they are many.
        for entry, a, b in zip(entries[cuts].tolist(), cuts, [*cuts[1:], len(at)]):
            new = [at[a:b]] if b - a >= FREQUENT else at[a:b].tolist()
            if entry in index:
                index[entry] += new
            else:
                index[entry] = new
                heapq.heappush(heap, entry)
        return ranks

    def plain(self, piece: bytes) -> list[int]:
        """The definition, one piece at a time."""
        ids = [int(self.byte_ids[b]) for b in piece]
        while True:
            ranks = [self.pairs.get(a << BITS | b) for a, b in zip(ids, ids[1:])]
            found = [(r, i) for i, r in enumerate(ranks) if r is not None]
            if not found:
                return ids
            rank, i = min(found)
            ids[i : i + 2] = [rank]

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (distinct, binary), end to end, and where each piece's ids end (from 0 on)."""
        found = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(False)
        single = found >= 0
        counts = single.astype(np.int64)
        todo = pieces.filter(pa.array(~single))
        merged, sizes = self._replay(todo)
        counts[~single] = sizes
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        ids = np.empty(int(ends[-1]), np.int32)
        ids[ends[:-1][single]] = self.known_ids[found[single]]
        ids[np.repeat(~single, counts)] = merged
        return ids, ends

    def _replay(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and their number for each piece."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets - offsets[0]
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        symbols = self.byte_ids[data].astype(np.int32)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        bounds = starts[1:] > starts[:-1]
        after[starts[1:][bounds] - 1] = -1
        before[starts[:-1][bounds]] = -1

        index: dict[int, list] = {}
        heap: list[int] = []
        at = np.flatnonzero(after >= 0).astype(np.int32)
        self._index(index, heap, at, symbols[at], symbols[at + 1])
        early: list[int] = []  # positions in words where the order of merges needs the plain way
        # One buffer, two views: whole arrays for frequent pairs, single items for the others.
        tok, nxt, prv = memoryview(symbols), memoryview(after), memoryview(before)
        rank_of, listed, push, low = self.pairs.get, index.get, heapq.heappush, (1 << BITS) - 1
        while heap:
            entry = heapq.heappop(heap)
            positions = index.pop(entry)
            rank, a, b = entry >> 2 * BITS, entry >> BITS & low, entry & low
            shared = rank in self.shared
            arrays = [x for x in positions if type(x) is np.ndarray]
            if arrays:
                few = [x for x in positions if type(x) is int]
                positions = np.concatenate([*arrays, np.array(few, np.int32)])
            if a != b and not shared and len(positions) >= FREQUENT:
                p = np.asarray(positions, np.int32)
                p = p[(symbols[p] == a) & (after[p] >= 0)]
                p = np.sort(p[symbols[after[p]] == b])
                p = p[np.r_[True, p[1:] != p[:-1]]] if len(p) else p
                q = after[p]
                r = after[q]
                symbols[p], symbols[q], after[p], after[q] = rank, -1, r, -1
                before[r[r >= 0]] = p[r >= 0]
                lefts = np.r_[p[r >= 0], before[p[before[p] >= 0]]]
                ranks = self._index(index, heap, lefts, symbols[lefts], symbols[after[lefts]])
                early += lefts[ranks < rank].tolist()
                continue
            for p in sorted(positions if type(positions) is list else positions.tolist()):
                q = nxt[p]
                if q < 0 or tok[p] != a or tok[q] != b:
                    continue  # a neighbour has changed meanwhile
                r, o = nxt[q], prv[p]
                if shared and a != b and (r >= 0 and rank_of(b << BITS | tok[r]) == rank or o >= 0 and rank_of(tok[o] << BITS | a) == rank):
                    early.append(p)
                tok[p], tok[q] = rank, -1
                nxt[p], nxt[q] = r, -1
                touched = []
                if r >= 0:
                    prv[r] = p
                    touched.append((p, rank << BITS | tok[r]))
                if o >= 0:
                    touched.append((o, tok[o] << BITS | rank))
                for position, key in touched:
                    new = rank_of(key)
                    if new is None:
                        continue
                    if new < rank:
                        early.append(position)
                    key |= new << 2 * BITS
                    known = listed(key)
                    if known is None:
                        index[key] = [position]
                        push(heap, key)
                    else:
                        known.append(position)
        alive = symbols >= 0
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=ends[1:])
        ids, sizes = symbols[alive].astype(np.int32), np.diff(ends[starts])
        if early:
            parts = np.split(ids, ends[starts[1:-1]])
            for k in set((np.searchsorted(starts, early, "right") - 1).tolist()):
                parts[k] = np.array(self.plain(pieces[k].as_py()), np.int32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], end to end."""
    ahead = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Encodes blocks of whole texts; keeps nothing from one block to the next."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.replay = Replay(ranks)
        self.split = regex.compile(pattern).findall
        self.segments = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])").split
        self.general = pattern != PATTERN

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The texts cut at single spaces between other characters.

        No piece of the pattern reaches over such a place, so a segment with the space before it is
        split alike wherever it stands.
        """
        if self.general:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        uneven = pc.match_substring_regex(texts, UNEVEN)
        cut = pc.split_pattern(texts, " ")
        if pc.any(uneven).as_py():
            cut = pa.array([self.segments(t.as_py()) if u.as_py() else c.as_py() for t, u, c in zip(texts, uneven, cut)], pa.list_(pa.string()))
        return cut

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's ids end (from 0 on)."""
        cut = self._cut(texts)
        offsets = cut.offsets.to_numpy(False).astype(np.int64)
        offsets -= offsets[0]
        flat = cut.flatten()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True  # a cut text has one segment at least
        segments = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(" ", flat, "")).dictionary_encode()
        which = segments.indices.to_numpy(False)
        distinct = segments.dictionary
        # A run of letters, with its space, is one piece; other segments are split by the pattern.
        simple = np.zeros(len(distinct), bool) if self.general else pc.match_substring_regex(distinct, "^ ?[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+$").to_numpy(False)
        rest = [self.split(x) for x in distinct.filter(pa.array(~simple)).to_pylist()]
        counts = simple.astype(np.int64)
        counts[~simple] = [len(x) for x in rest]
        spelt = pa.concat_arrays([distinct.filter(pa.array(simple)), pa.array([w for x in rest for w in x], pa.string())]).dictionary_encode()
        ids, ends = self.replay.encode(spelt.dictionary.cast(pa.binary()))
        # Pieces in the order of the segments: those of letters first, then the others.
        numbers = spelt.indices.to_numpy(False)
        order = np.concatenate([np.flatnonzero(simple), np.repeat(np.flatnonzero(~simple), counts[~simple])])
        numbers = numbers[np.argsort(order, kind="stable")]
        piece_sizes = np.diff(ends)[numbers]
        pool = _gather(ids, ends[:-1][numbers], piece_sizes)
        reached = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(piece_sizes, out=reached[1:])
        cuts = np.zeros(len(distinct) + 1, np.int64)
        np.cumsum(counts, out=cuts[1:])
        segment_ends = reached[cuts]
        sizes = np.diff(segment_ends)[which]
        out = _gather(pool, segment_ends[:-1][which], sizes)
        reached = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=reached[1:])
        return out, reached[offsets]


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(data), pattern)


@lru_cache(maxsize=2)
def _tokens(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The tokens, and where each id's token stands among them (-1: no such id)."""
    ranks = parse_ranks(data)
    place = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
    place[list(ranks.values())] = np.arange(len(ranks))
    return pa.array(list(ranks), pa.binary()), place


def read_vocabulary(path: str) -> bytes:
    """The rank file (about 1 MB), read on the driver and broadcast to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_array(texts: pa.Array, data: bytes, pattern: str = PATTERN, block_bytes: int | None = None) -> pa.Array:
    """The ids of each text. A larger block replays fewer pieces again, and takes more memory."""
    encoder = _encoder(data, pattern)
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(False).astype(np.int64)
    block = (np.cumsum(lengths) - lengths) // (block_bytes or BLOCK_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if len(texts) else [0]
    parts, ends = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for a, b in zip(cuts, cuts[1:]):
        ids, reached = encoder.encode(texts[a:b].fill_null(""))
        parts.append(ids)
        ends.append(reached[1:] + ends[-1][-1])
        give_back()
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(parts)))


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, end to end, and where each list's values end (from 0 on); null reads as empty."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(False), out=ends[1:])
    return lists.flatten().to_numpy(False), ends


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def decode_array(lists: pa.Array, data: bytes) -> pa.Array:
    """The bytes of each list of ids: all tokens are taken at once, and their bytes stand end to end."""
    tokens, place = _tokens(data)
    ids, ends = _lists(lists)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(place) or (place[ids] < 0).any()):
        raise ValueError("an id that the vocabulary does not have")
    taken = tokens.take(pa.array(place[ids])) if len(ids) else pa.array([], pa.binary())
    spelt = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(pc.binary_length(taken).to_numpy(False), out=spelt[1:])
    return _binary(spelt[ends], taken.buffers()[2] or pa.py_buffer(b""))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """Adds `out` (array of int): the ids of each whole text, without special tokens."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_array(texts, data.value, pattern)

    # The ids are never null. The expression around the step keeps Spark from nesting it into each Python
    # step that reads the ids, which would encode every text once for each of them.
    return docs.withColumn(out, F.coalesce(encode(text_of(text)), F.array().cast("array<int>")))


def bpe_packed(
    docs: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens", pattern: str = PATTERN, dtype: str = "<u2", block_bytes: int = 4 * BLOCK_BYTES
) -> DataFrame:
    """Adds `out` (binary): the ids of each whole text as little-endian numbers of `dtype`."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        ids, ends = _lists(encode_array(texts, data.value, pattern, block_bytes))
        if len(ids) and ids.max() > np.iinfo(dtype).max:
            raise ValueError(f"an id that {dtype} can't hold")
        return _binary(ends * np.dtype(dtype).itemsize, pa.py_buffer(ids.astype(dtype)))

    return docs.withColumn(out, encode(text_of(text)))


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out` (binary): the bytes the ids stand for. Null ids give empty bytes."""
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        decoded = decode_array(lists, data.value)
        give_back()
        return decoded

    return df.withColumn(out, decode(F.col(f"`{ids}`")))


@F.arrow_udf(T.StringType())
def ids_sha256(lists: pa.Array) -> pa.Array:
    """Hex digest of the ids as little-endian unsigned 32-bit integers."""
    ids, ends = _lists(lists)
    data = memoryview(ids.astype("<u4").tobytes())
    cuts = (ends * 4).tolist()
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())
