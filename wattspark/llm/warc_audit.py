"""Merkle fixity audit of WARC replicas.

`write_warc` stores pages as WARC files, each record a gzip member of its own, so that a record can be
read alone; several replicas are written in one pass. `record_leaves` reads a replica's files, cuts them
into records and hashes each: leaves are (file, record number, offset, length, digest). Offsets and
lengths are those of the records as they were before compression; a member names both of its sizes in
its header, so the members are found, and the offsets kept, where the bytes of one are damaged. `merkle_levels` builds the tree by rising levels: a node
hashes the ordered offset ranges and digests of up to `FAN` children, first within each file, then
over the files, up to one root for the replica. Every level is one aggregation of groups of at most
`FAN` rows, and is stored, so a lost executor costs one level at most.

`audit` compares the replicas' roots and descends: of each level only the children of differing nodes
are joined, down to the records. An intact branch is never read below its top, and what is read
grows with the damage and the depth, not with the archive.

A damaged member is a leaf of its stored bytes under the length its header or, where that is lost, its
trailer names. Plain records in a file are cut at their own headers.

Defined cases: null urls and pages read as empty; a file or record on one side only is `missing` or
`extra`; a damaged header that hides where a record ends joins the bytes up to the next record;
repeated pages are repeated records; empty replicas are equal.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.files import WholeFile
from wattspark.operators.common import settle

FAN = 16
PER_FILE = 200  # page numbers of one file

_START = b"WARC/1.0\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^>]*)>\r\n")


def record_bytes(page: str, url: bytes, html: bytes) -> bytes:
    head = [
        b"WARC/1.0",
        b"WARC-Type: resource",
        b"WARC-Record-ID: <urn:page:" + page.encode() + b">",
        b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b"%0A", url),
        b"WARC-Payload-Digest: sha256:" + hashlib.sha256(html).hexdigest().encode(),
        b"Content-Type: text/html",
        b"Content-Length: " + str(len(html)).encode(),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + html + b"\r\n\r\n"


# Fixed value: gzip's header with one extra field, "sl", of two sizes (stored and unpacked, four bytes each).
_MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_HEAD = len(_MEMBER) + 8
LARGEST = 2**32 - 1  # bytes of a record


def member(record: bytes) -> bytes:
    """The record as a gzip member that names its sizes."""
    if len(record) > LARGEST:
        raise ValueError("a record above 4 GB")
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record))
    return _MEMBER + struct.pack("<II", _HEAD + len(body) + 8, len(record)) + body + tail


def unpacked(stored: bytes) -> bytes | None:
    """The record of a member whose data and check sum agree, else None."""
    try:
        unpack = zlib.decompressobj(31)
        record = unpack.decompress(stored)
    except zlib.error:
        return None
    return record if unpack.eof and not unpack.unused_data else None


def file_name(number: int) -> str:
    return f"pages-{number:09d}.warc.gz"


def write_warc(
    pages: DataFrame,
    folder: str | dict[str, Column | None],
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    per_file: int = PER_FILE,
    damage: Column | None = None,
) -> DataFrame:
    """Writes the pages in the order of their key, `per_file` key numbers a file, and returns what was
    written: replica, file_no, bytes. Pages without a key come first, in file 0.

    `folder` is one folder, or several with the `damage` of each: the replicas of one pass. `damage` (for drills) is a
    boolean column: the first byte of such a page's payload is flipped after its digest was taken.
    """
    replicas = folder if isinstance(folder, dict) else {folder: damage}
    rows = pages.select(
        F.coalesce(F.floor(F.col(f"`{key}`") / per_file), F.lit(0)).cast("long").alias("file_no"),
        F.col(f"`{key}`").cast("string").alias("page"),
        F.coalesce(F.col(f"`{url}`"), F.lit("")).cast("binary").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("html"),
        F.array(*(F.coalesce(d if d is not None else F.lit(False), F.lit(False)) for d in replicas.values())).alias("bad"),
        F.col(f"`{key}`").alias("at"),
    )
    rows = rows.repartition(F.col("file_no")).sortWithinPartitions("file_no", "at", "url", "html")
    folders = list(replicas)
    schema = T.StructType([T.StructField("replica", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("bytes", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[WholeFile] = []
        current, sizes = None, [0] * len(folders)
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            for f, where, size in zip(files, folders, sizes):
                f.close()
                done.append((where, current, size))

        for b in batches:
            columns = [b.column(c) for c in ("file_no", "page", "url", "html", "bad")]
            for number, page, url, html, bad in zip(*columns):
                if number.as_py() != current:
                    close()
                    current, sizes = number.as_py(), [0] * len(folders)
                    files = [WholeFile(f, file_name(current)) for f in folders]
                payload = html.as_py()
                record = record_bytes(page.as_py() or "", url.as_py(), payload)
                whole = member(record)
                for i, broken in enumerate(bad.as_py()):
                    data = whole
                    if broken and payload:
                        at = len(record) - 4 - len(payload)
                        data = member(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])
                    files[i].write(data)
                    sizes[i] += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], names=schema.names)

    return rows.select("file_no", "page", "url", "html", "bad").mapInArrow(write, schema)


def split_records(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(offset, length, page id) of each record; together they cover all bytes."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        head = data[at : head_end + 2] if head_end >= 0 else b""
        length = _LENGTH.search(head) if head.startswith(_START) else None
        stop = head_end + 4 + int(length[1]) + 4 if length else -1
        if length is None or stop > len(data) or (stop < len(data) and not data.startswith(_START, stop)):
            following = data.find(b"\r\n\r\n" + _START, at)
            stop = following + 4 if following >= 0 else len(data)
        name = _ID.search(head)
        yield at, stop - at, name[1].decode("utf-8", "replace") if name else None
        at = stop


def stored_records(data: bytes) -> Iterator[tuple[int, int, str | None, str]]:
    """(offset, length, page id, digest) of each record of a stored file, in its unpacked offsets."""
    at = start = 0
    while at < len(data):
        if data.startswith(_MEMBER, at) and at + _HEAD <= len(data):
            size, length = struct.unpack_from("<II", data, at + len(_MEMBER))
            stop = at + size
            stored = data[at:stop]
            record = unpacked(stored)
            # The size is believed where the record is whole, or the next member or the end stands at the place it names.
            if record is not None or size > _HEAD and (stop == len(data) or data.startswith(_MEMBER, stop)):
                name = _ID.search(record, 0, record.find(b"\r\n\r\n") + 2) if record is not None else None
                intact = record is not None and len(record) == length
                length = length if record is None else len(record)
                yield start, length, name[1].decode("utf-8", "replace") if name else None, hashlib.sha256(record if intact else stored).hexdigest()
                at, start = stop, start + length
                continue
        stop = data.find(_MEMBER, at + 1)
        stop = stop if stop >= 0 else len(data)
        rest = data[at:stop]
        if rest.startswith(_START):
            for s, n, name in split_records(rest):
                yield start + s, n, name, hashlib.sha256(rest[s : s + n]).hexdigest()
            length = len(rest)
        else:
            length = struct.unpack("<I", rest[-4:])[0] if len(rest) > _HEAD else len(rest)
            yield start, length, None, hashlib.sha256(rest).hexdigest()
        at, start = stop, start + length


def record_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """file_no, idx, start, length, page, hash: the records of all files of a replica."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder).select("path", "content")
    schema = T.StructType(
        [
            T.StructField("file_no", T.LongType()),
            T.StructField("idx", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("page", T.StringType()),
            T.StructField("hash", T.StringType()),
        ]
    )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                number = int(re.search(r"pages-(\d+)\.warc", path.as_py())[1])
                rows = [
                    {"file_no": number, "idx": i, "start": s, "length": n, "page": p, "hash": h}
                    for i, (s, n, p, h) in enumerate(stored_records(content.as_py()))
                ]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in schema]))

    return files.mapInArrow(leaves, schema)


def last_numbers(*leaves: DataFrame) -> tuple[int, int]:
    """The largest record number within a file and the largest file number, over all replicas."""
    tops = [t.agg(F.max("idx"), F.max("file_no")).first() for t in leaves]
    return max(t[0] or 0 for t in tops), max(t[1] or 0 for t in tops)


def merkle_levels(leaves: DataFrame, last_record: int, last_file: int) -> list[DataFrame]:
    """The stored levels from the leaves up to the root: g, idx (node), start, end, hash, parent_g, parent.

    Nodes of a file have its number as g; from the file roots on, g is -1 and idx counts files.
    """
    steps: list[tuple[Column, Column]] = []
    while True:
        last_record //= FAN
        if last_record == 0:
            steps.append((F.lit(-1).cast("long"), F.col("g")))
            break
        steps.append((F.col("g"), F.floor(F.col("idx") / FAN)))
    while last_file > 0:
        steps.append((F.lit(-1).cast("long"), F.floor(F.col("idx") / FAN)))
        last_file //= FAN
    level = leaves.select(F.col("file_no").alias("g"), "idx", "start", (F.col("start") + F.col("length")).alias("end"), "hash")
    out = []
    for parent_g, parent in steps:
        level = settle(level.withColumn("parent_g", parent_g).withColumn("parent", parent))
        out.append(level)
        children = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "hash")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["idx"], c["start"], c["end"], c["hash"])), "|")
        level = level.groupBy("parent_g", "parent").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(text, 256).alias("hash"))
        level = level.select(F.col("parent_g").alias("g"), F.col("parent").alias("idx"), "start", "end", "hash")
    root = level.withColumn("parent_g", F.lit(None).cast("long")).withColumn("parent", F.lit(None).cast("long"))
    return [*out, settle(root)]


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Damaged records: g (file), idx, status (differs, missing, extra), from the levels of two trees."""
    if len(a) != len(b):
        raise ValueError("build both trees with the same last numbers")
    suspects = None
    for depth in reversed(range(len(a))):
        x, y = a[depth], b[depth]
        if suspects is not None:
            x, y = (t.join(suspects, ["parent_g", "parent"], "left_semi") for t in (x, y))
        x = x.select("g", "idx", "start", "end", F.col("hash").alias("ha"))
        y = y.select("g", "idx", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("hash").alias("hb"))
        same = (F.col("ha") == F.col("hb")) & (F.col("start") == F.col("start_b")) & (F.col("end") == F.col("end_b"))
        status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("differs")
        bad = settle(x.join(y, ["g", "idx"], "full").where(~F.coalesce(same, F.lit(False))).select("g", "idx", status.alias("status")))
        suspects = bad.select(F.col("g").alias("parent_g"), F.col("idx").alias("parent"))
    return bad
