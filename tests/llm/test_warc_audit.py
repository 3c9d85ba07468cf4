import gzip
import hashlib

from pyspark.sql import functions as F

from wattspark.llm import warc_audit as w
from wattspark.llm.files import open_folder
from wattspark.operators.common import scratch_path, settle

PAGES = [(i, f"https://h{i % 7}.example/{i}", "é<p>" * (i % 50)) for i in range(0, 900, 2)] + [(4, "https://again", "twice"), (4, "https://again", "twice"), (7, None, None), (8, "a\r\nb", ""), (None, "u", "x" * 70000), (9, "WARC/1.0\r\n", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(*p, "f") for p in PAGES], "page_id long, url string, html string, file_no string")


def replica(spark, df, **how):
    folder = scratch_path(spark, "replica-test")
    settle(w.write_warc(df, folder, per_file=40, **how))
    return folder


def compare(spark, one, two):
    a, b = (settle(w.record_leaves(spark, f)) for f in (one, two))
    last = w.last_numbers(a, b)
    found = w.audit(w.merkle_levels(a, *last), w.merkle_levels(b, *last))
    return a, b, {(r.g, r.idx): r.status for r in found.collect()}


def content(folder):
    fs, root = open_folder(folder)
    from pyarrow.fs import FileSelector

    out = {}
    for x in fs.get_file_info(FileSelector(root)):
        with fs.open_input_stream(x.path, compression=None) as f:
            out[x.base_name] = f.read()
    return out


def test_records_cover_every_byte(spark):
    folder = replica(spark, pages(spark))
    files = content(folder)
    leaves = w.record_leaves(spark, folder).orderBy("file_no", "idx").collect()
    assert len(leaves) == len(PAGES)
    for name, data in files.items():
        own = [r for r in leaves if w.file_name(r.file_no) == name]
        data = gzip.decompress(data)
        assert sum(r.length for r in own) == len(data) and own[0].start == 0
        for r in own:
            assert hashlib.sha256(data[r.start : r.start + r.length]).hexdigest() == r.hash
    assert sorted(r.page for r in leaves) == sorted(str(p[0]) if p[0] is not None else "" for p in PAGES)


def test_equal_replicas(spark):
    _, _, found = compare(spark, replica(spark, pages(spark)), replica(spark, pages(spark).repartition(3)))
    assert found == {}


def test_damage_is_located(spark):
    a, b, found = compare(spark, replica(spark, pages(spark)), replica(spark, pages(spark), damage=F.expr("page_id % 97 = 12")))
    x = {(r.file_no, r.idx): r.hash for r in a.collect()}
    y = {(r.file_no, r.idx): r.hash for r in b.collect()}
    assert found == {k: "differs" for k in x if x[k] != y[k]}
    damaged = [p[0] for p in PAGES if p[0] is not None and p[0] % 97 == 12 and p[2]]
    assert len(found) == len(damaged) > 2


def test_truncated_and_missing_files(spark):
    one, two = replica(spark, pages(spark)), replica(spark, pages(spark).where("page_id < 700 or page_id is null").where("page_id is null or page_id not between 150 and 159"))
    a, b, found = compare(spark, one, two)
    x = {(r.file_no, r.idx): (r.start, r.length, r.hash) for r in a.collect()}
    y = {(r.file_no, r.idx): (r.start, r.length, r.hash) for r in b.collect()}
    want = {k: "missing" if k not in y else "extra" if k not in x else "differs" for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert found == want and "missing" in found.values()


def test_broken_headers_stay_in_their_record():
    first, second = w.record_bytes("1", b"u", b"abc"), w.record_bytes("2", b"v", b"defg")
    broken = b"XARC" + first[4:]
    assert [(s, n) for s, n, _ in w.split_records(broken + second)] == [(0, len(first)), (len(first), len(second))]
    longer = first.replace(b"Content-Length: 3", b"Content-Length: 9")
    assert sum(n for _, n, _ in w.split_records(longer + second)) == len(longer + second)
    assert list(w.split_records(b"")) == []
    assert list(w.split_records(b"junk")) == [(0, 4, None)]


def test_replicas_of_one_pass(spark):
    here, there = scratch_path(spark, "replica-test"), scratch_path(spark, "replica-test")
    made = settle(w.write_warc(pages(spark), {here: None, there: F.expr("page_id = 12")}, per_file=40)).collect()
    assert {(r.replica, w.file_name(r.file_no)): r.bytes for r in made} == {(f, n): len(d) for f in (here, there) for n, d in content(f).items()}
    assert content(here) == content(replica(spark, pages(spark)))
    a, _, found = compare(spark, here, there)
    assert found == {(r.file_no, r.idx): "differs" for r in a.collect() if r.page == "12"} != {}


def test_damaged_members_keep_the_others_in_place():
    records = [w.record_bytes(str(i), b"u", bytes([65 + i]) * (300 * i)) for i in range(5)]
    stored = [w.member(r) for r in records]
    whole = list(w.stored_records(b"".join(stored)))
    assert [(n, p, h) for _, n, p, h in whole] == [(len(r), str(i), hashlib.sha256(r).hexdigest()) for i, r in enumerate(records)]
    assert [s for s, *_ in whole] == [sum(map(len, records[:i])) for i in range(5)]
    assert b"".join(gzip.decompress(m) for m in stored) == b"".join(records)
    at_2 = len(stored[0]) + len(stored[1])
    for place in range(len(stored[2])):
        data = bytearray(b"".join(stored))
        data[at_2 + place] ^= 1
        found = list(w.stored_records(bytes(data)))
        assert found[:2] + found[3:] == whole[:2] + whole[3:] and found[2] != whole[2]
    assert list(w.stored_records(b"")) == []
    cut = b"".join(stored)[:-5]
    plain = records[0] + records[1]
    assert [x[:3] for x in w.stored_records(plain)] == [x[:3] for x in whole[:2]]
    assert list(w.stored_records(cut))[:4] == whole[:4] and len(list(w.stored_records(cut))) >= 5


def test_empty_replicas(spark):
    none = pages(spark).limit(0)
    folder = scratch_path(spark, "replica-test")
    settle(w.write_warc(none, folder))
    fs, root = open_folder(folder)
    fs.create_dir(root)
    _, _, found = compare(spark, folder, folder)
    assert found == {}
