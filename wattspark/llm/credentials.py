"""Secret scans: plain credential patterns, and weak parts linked when complementary ones co-occur.

The base patterns stand for themselves. Weak parts (an access identifier, a bare secret, an
endpoint) say little alone. Inside a scope (by default `SCOPE` characters to either side, within
one paragraph) the parts are interval-joined: both lists are sorted by position and swept once, so
a text of many parts never makes their pairs. A weak part is reported only when its complement
co-occurs: an identifier with a secret, a secret with an identifier or an endpoint, an endpoint
with both a secret and an identifier. Base spans count as parts, too: `access` as an identifier,
`assign` and `hex` as secrets.

A scope never leaves its document, so the join is done where the text lies, without a shuffle.

Defined cases: null and empty texts have no spans; overlapping spans of different kinds all stay;
equal spans of one kind are one; repeated rows give repeated results.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.common import free_name, give_back, text_of

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "bare_secret", "endpoint")

# Weak parts.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z])(?:client|account|tenant|app|key|user)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{4,128})|(?<![A-Z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,124}(?![A-Z0-9])""",
    re.IGNORECASE,
)
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]{3,}")
SCOPE = 300
ENTROPY = 3.5  # bits a character from which a bare run reads as a random secret

_SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
SPANS = T.ArrayType(_SPAN)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and not overlapping within a kind."""
    found = []
    if _separators(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _separators(text: str) -> bool:
    return "=" in text or ":" in text


def random_looking(run: str) -> bool:
    """Letters of both cases and digits, and a high entropy."""
    if not (any(map(str.isdigit, run)) and any(map(str.islower, run)) and any(map(str.isupper, run))):
        return False
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values()) >= ENTROPY


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    taken = sorted((s, e) for s, _, e in base)
    # The furthest end among the base spans up to each: a short span may follow inside a longer one.
    reach = list(accumulate((e for _, e in taken), max))
    free = lambda s, e: not ((i := bisect.bisect_left(taken, (e, 0))) and reach[i - 1] > s)
    found = []
    if _separators(text) or "A" in text:
        found += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in BARE.finditer(text) if random_looking(m.group())]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return [x for x in found if free(x[0], x[2])]


def _near(sorted_parts: list[tuple[int, int]], start: int, end: int, lo: int, hi: int) -> bool:
    """Does a part overlap the scope [lo, hi)? The part itself does not count."""
    i = bisect.bisect_left(sorted_parts, (lo, 0))
    while i < len(sorted_parts) and sorted_parts[i][0] < hi:
        if sorted_parts[i] != (start, end):
            return True
        i += 1
    return False


def link(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """The weak parts whose complement starts in their scope."""
    parts = base + weak
    ids = sorted((s, e) for s, k, e in parts if k in (1, 3))
    secrets = sorted((s, e) for s, k, e in parts if k in (0, 2, 4))
    ends = sorted((s, e) for s, k, e in parts if k == 5)
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    kept = []
    for s, k, e in weak:
        b = bisect.bisect_right(breaks, s)
        lo = max(s - scope, breaks[b - 1] if b else 0)
        hi = min(e + scope, breaks[b] if b < len(breaks) else len(text))
        has_id, has_secret, has_end = (_near(x, s, e, lo, hi) for x in (ids, secrets, ends))
        if (k == 3 and has_secret) or (k == 4 and (has_id or has_end)) or (k == 5 and has_secret and has_id):
            kept.append((s, k, e))
    return kept


def spans_of(text: str, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    weak = weak_spans(text, base)
    return sorted(set(base + (link(text, base, weak, scope) if weak else [])))


def secret_spans(docs: DataFrame, text: str = "text", out: str = "spans", scope: int = SCOPE) -> DataFrame:
    """Adds `out`: array of (kind, start, end) by start, then kind; code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [spans_of(v.as_py() or "", scope) for v in texts]
        return pa.array(
            [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in rows],
            pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
        )

    return docs.withColumn(out, scan(text_of(text)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """`docs` with every identifier and secret found in `text` replaced by `mark`.

    Endpoints are left in place: they only serve as evidence. A null text stays null.
    """
    s = free_name(docs, "_spans")

    @F.arrow_udf(T.StringType())
    def cover(texts: pa.Array) -> pa.Array:
        out = []
        for v in texts:
            value, at, parts = v.as_py() or "", 0, []
            for start, kind, end in spans_of(value, scope):
                if kind == 5 or end <= at:
                    continue
                if start >= at:
                    parts += [value[at:start], mark]
                at = end
            out.append("".join(parts) + value[at:])
        result = pa.array(out, pa.string())
        del out
        give_back()
        return result

    return docs.withColumn(s, cover(text_of(text))).withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.col(s))).drop(s)
