import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wattspark.llm import bpe, queries
from wattspark.llm import training_order as t
from wattspark.operators.common import scratch_path


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = t.slots(np.arange(n), n, "k")
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != t.slots(np.arange(n), n, "other")).any()
        assert np.corrcoef(got, np.arange(n))[0, 1] < 0.2


def rows():
    r = random.Random(1)
    out = [(i, "".join(r.choice("abc é\n") for _ in range(r.randint(0, 300)))) for i in range(200)]
    return out + [(500, None), (501, ""), (3, out[3][1]), (None, "no id"), (502, "z" * 5000)]


@pytest.mark.parametrize("stage", [False, True])
def test_round_trip(spark, stage):
    data = rows()
    df = spark.createDataFrame([(*x, "s") for x in data], "doc_id long, text string, slot string").repartition(5, "doc_id")
    folder = scratch_path(spark, "shards-test")
    made = t.write_shards(t.byte_tokens(df), folder, "key", length=64, per_shard=50, stage=stage).toPandas()
    n = len(made)
    assert sorted(made["slot"]) == list(range(n))
    read = list(t.read_slots(folder, 0, n, length=64, per_shard=50))
    assert len(read) == n
    assert all((made["shard"] == made["slot"] // 50) & (made["byte_offset"] == made["slot"] % 50 * 64))
    for r in made.itertuples():
        assert hashlib.sha256(read[r.slot].tobytes()).hexdigest() == r.sha256
    # Documents come back whole: sequences of a document are found by its id, texts by the end token.
    by_id = {}
    for k, x in data:
        by_id.setdefault(k, []).append((x or "").encode())
    for r in made.itertuples():
        parts = read[r.slot].tobytes()[: r.n_tokens].split(b"\xff")
        assert len(r.docs) in (len(parts), len(parts) - 1)
        for k, part in zip(r.docs, parts):
            k = None if k is None or k != k else int(k)
            assert any(part in x for x in by_id[k])
    total = sum(len((x or "").encode()) + 1 for _, x in data)
    assert made["n_tokens"].sum() == total
    joined = b"".join(x.tobytes()[:k] for x, k in zip((read[s] for s in made["slot"]), made["n_tokens"]))
    assert joined.count(b"\xff") == len(data)


def test_the_query_writes_token_ids(spark, tmp_path, monkeypatch):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"file://{tmp_path}/shards"
    monkeypatch.setattr(queries, "scratch_path", lambda *a: folder)
    made = queries.op2_training_order(spark, str(tmp_path)).orderBy("slot").collect()
    ranks = bpe.parse_ranks(bpe.read_vocabulary(queries.vocabulary()))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [library.encode_ordinary(x or "") for _, x in data]
    assert sum(r.n_tokens for r in made) == sum(len(x) + 1 for x in ids)
    read = list(t.read_slots(folder, 0, len(made), dtype="<u2"))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == [r.sha256 for r in made]
    got = [v for r, x in zip(made, read) for v in x[: r.n_tokens].tolist()]
    assert sum(v == queries.TOKEN_END for v in got) == len(data)
    assert sorted(v for v in got if v != queries.TOKEN_END) == sorted(v for x in ids for v in x)


def test_reading_resumes_anywhere(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    folder = scratch_path(spark, "shards-test")
    n = t.write_shards(t.byte_tokens(df), folder, "key", length=32, per_shard=7).count()
    whole = [x.tobytes() for x in t.read_slots(folder, 0, n, length=32, per_shard=7)]
    for first in (0, 5, 7, 20, n - 1):
        assert [x.tobytes() for x in t.read_slots(folder, first, 30, length=32, per_shard=7)] == whole[first : first + 30]


def test_wide_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [5, 70000, 9]), (2, None), (3, [])], "doc_id long, ids array<int>")
    packed = t.packed_tokens(df, "ids", dtype="<u4")
    folder = scratch_path(spark, "shards-test")
    made = t.write_shards(packed, folder, "key", itemsize=4, end=2**32 - 1, pad=0, length=4, per_shard=3).collect()
    seen = [x.tolist() for x in t.read_slots(folder, 0, len(made), length=4, per_shard=3, dtype="<u4")]
    assert sorted(x for s in seen for x in s if x) == sorted([5, 70000, 9] + [2**32 - 1] * 3)
    empty = t.write_shards(t.byte_tokens(spark.createDataFrame([], "doc_id long, text string")), scratch_path(spark, "s"), "key")
    assert empty.count() == 0


@pytest.mark.parametrize("per_shard", [2, 100])
def test_a_changed_layout_is_noticed(spark, per_shard):
    """Six files are six partitions when they are counted and one when they are packed: slots are missing."""
    path = scratch_path(spark, "docs")
    for k in range(6):
        spark.createDataFrame([(k, "short")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    confs = {"spark.sql.files.maxPartitionBytes": ("1", "128m"), "spark.sql.files.openCostInBytes": ("1", "1"), "spark.sql.files.minPartitionNum": ("6", "1")}
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, (first, _) in confs.items():
            spark.conf.set(c, first)
        made = t.write_shards(t.byte_tokens(spark.read.parquet(path)), scratch_path(spark, "shards-test"), "key", length=1024, per_shard=per_shard)
        for c, (_, second) in confs.items():
            spark.conf.set(c, second)
        with pytest.raises(Exception, match="stage=True"):
            made.collect()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
