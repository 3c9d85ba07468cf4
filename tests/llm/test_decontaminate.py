import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wattspark.llm import decontaminate as d
from wattspark.llm import queries
from wattspark.operators.common import settle


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_matches(text, items, window=10, slop=0):
    words = plain_words(text)
    out = {}
    for item, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[k : k + window]
            for s in range(len(words) - len(phrase) + 1):
                near = all(any(0 <= s + i + j < len(words) and words[s + i + j] == x for j in range(-slop, slop + 1)) for i, x in enumerate(phrase))
                if near:
                    at = (str(item) if item is not None else "", s, len(phrase))
                    out[at] = out.get(at, False) or words[s : s + len(phrase)] == phrase
    return {(*at, exact) for at, exact in out.items()}


def corpus():
    r = random.Random(4)
    vocab = ["the", "of", "and", "é", "x1", "Ab", "zz", "q", "lorem", "dolor"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (10, text(4)), (3, "one, two;THREE"), (4, None), (5, " -- "), (7, text(10))]
    items += [(None, items[1][1])]
    docs = [(i, text(r.randint(0, 80))) for i in range(40)]
    docs += [(100 + k, f"{text(9)} {t} {text(5)} {t}") for k, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "One two. three"), (202, "One two. three"), (203, (items[0][1] + " ") * 200), (None, items[1][1])]
    return docs, items


def found(df, key):
    return sorted((repr(r[key]), sorted((m.item_id, m.start, m.length, m.exact) for m in r.matches)) for r in df.collect())


def want(docs, items, **how):
    return sorted((repr(k), sorted(plain_matches(t, items, **how))) for k, t in docs)


def test_stored_index_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    index = settle(d.build_index(df, block_words=50))
    assert found(d.search_index(index, b), "doc_key") == want(docs, items)


def test_proximity_and_other_windows(spark):
    docs, items = corpus()
    docs = docs[:44]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    index = d.build_index(df)
    assert found(d.search_index(index, b, window=5, slop=1), "doc_key") == want(docs, items, window=5, slop=1)
    assert any(not m[3] for _, ms in want(docs, items, window=5, slop=1) for m in ms)


def test_the_query_returns_proximity_matches(spark, tmp_path):
    words = [f"w{i}" for i in range(24)]
    item = " ".join(words)
    # One word inside each ten words more, or less; a copy; neither.
    more = " ".join(w + (" new" if i % 8 == 4 else "") for i, w in enumerate(words))
    less = " ".join(w for i, w in enumerate(words) if i % 8 != 4)
    swapped = " ".join(w for a, b in zip(words[::2], words[1::2]) for w in (b, a))
    docs = [(1, f"x {item} y"), (2, f"x {more} y"), (3, f"x {swapped} y"), (4, f"x {less} y"), (5, "nothing here"), (6, None)]
    items = [(7, item), (8, "q r s")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries.op8_positional_index(spark, str(tmp_path)).collect()}
    for k, text in docs:
        truth = plain_matches(text, items, slop=queries.SLOP)
        exact = {m for m in truth if m[3]}
        near = {m[0] for m in truth} - {m[0] for m in exact}
        assert (got[k].n_near_items, got[k].near_items) == (len(near), ",".join(sorted(near)))
        assert got[k].n_hit == len({i for _, s, n, _ in exact for i in range(s, s + n)})
        assert (got[k].contaminated, got[k].n_items) == (bool(exact), len({m[0] for m in exact}))
    assert [(got[k].contaminated, got[k].near_items) for k in (1, 2, 3, 5)] == [(True, ""), (False, "7"), (False, "7"), (False, "")]


def test_rows_judged_in_place(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(d, "BLOCK_WORDS", 60)
    df = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, _matches string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(d.with_matches(df, b), "doc_id") == want(docs, items)
    clean = d.drop_contaminated(df, b)
    assert clean.columns == df.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(k) for k, t in docs if not plain_matches(t, items))


def test_slices_of_the_benchmark(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    sliced = d.benchmark_slices
    monkeypatch.setattr(d, "benchmark_slices", lambda *a: sliced(*a[:3], 60))
    assert len(list(d.benchmark_slices(b, "item_id", "text"))) > 2
    assert found(d.search_index(d.build_index(df), b), "doc_key") == want(docs, items)
    assert found(d.with_matches(df, b), "doc_id") == want(docs, items)


def test_stored_blocks_are_small_and_lie_alone(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    # As in prose, few words make most of the text.
    docs = [(i, " ".join(vocab[int(3000 * r.random() ** 4)] for _ in range(1000))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = settle(d.build_index(df, block_words=100_000), d.STORED)
    blocks = [sum(len(x) if isinstance(x, bytes | bytearray) else 4 * len(x) for x in row) for row in index.collect()]
    # What the JVM passes on of a block is less than its text.
    assert len(blocks) > 2 and sum(blocks) < 0.6 * sum(len(t) for _, t in docs)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in index.inputFiles()]
    assert sum(groups) == len(blocks)
    b = spark.createDataFrame([(1, " ".join(docs[7][1].split()[5:30]))], "item_id long, text string")
    assert {r.doc_key for r in d.search_index(index, b).collect() if r.matches} == {7}


def test_packed_numbers():
    r = np.random.default_rng(3)
    for x in ([], [0], [2**31 - 1, 0, 2**31 - 1], r.integers(0, 2**31, 1000), np.sort(r.integers(0, 9999, 1000))):
        assert d.unpacked_numbers(pa.py_buffer(d.packed(np.array(x, np.int64)))).tolist() == list(x)


def test_a_block_full_of_matches_keeps_them_as_arrays():
    cycle = [b"w%d" % i for i in range(10)]
    texts = pa.array([b" ".join(cycle * 100)] * 100, pa.binary())
    phrases = d.Phrases([(str(k), b" ".join(cycle * 2)) for k in range(2)], 10)
    block = d.Postings.of(texts)
    tracemalloc.start()
    try:
        found = block.matches(phrases, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(x) for x in found] == [2 * 991] * 100
    # Below 200 bytes a match; as Python objects they took 367.
    assert peak < 200 * 2 * 991 * 100


def test_digest_columns(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = d.search_index(d.build_index(df), b).select("doc_key", d.covered_words(F.col("matches")).alias("hit"), d.matched_items(F.col("matches")).alias("items")).collect()
    truth = {}
    for k, t in docs:
        m = plain_matches(t, items)
        truth[repr(k)] = (len({p for _, s, n, _ in m for p in range(s, s + n)}), sorted({x[0] for x in m}))
    assert {repr(r.doc_key): (r.hit, list(r["items"])) for r in rows} == truth


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [len(r.matches) for r in d.search_index(d.build_index(docs), none).collect()] == [0]
    assert d.drop_contaminated(docs, none).count() == 1
    assert d.search_index(d.build_index(docs.limit(0)), none).count() == 0
