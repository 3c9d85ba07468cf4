"""The pipeline against a brute-force version over a small folder of tables."""

import random
import re

import public_tokenizers
import pytest
import tiktoken
from test_bpe import PATH
from test_credentials import plain_base
from test_decontaminate import plain_matches
from test_quality import plain_verdicts
from test_simhash import plain_components, plain_fingerprint

from pyspark.sql import functions as F

from wattspark.llm import bpe, credentials
from wattspark.operators.common import scratch_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("aeioubcdt") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(i, prose(12)) for i in range(4)]
    docs = [(i, prose(r.randint(55, 120)), r.choice(["en", "de"]), "src0") for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "src0") for i in range(5)]  # copies
    docs += [(210 + i, f"{prose(60)} {items[i][1]} {prose(9)}", "en", "s") for i in range(4)]  # leaks
    docs += [(220, prose(60) + ' token = "abcdef0123456789abcdef0123456789" ' + prose(9), "fr", "s"), (221, "too short", "en", "s"), (222, None, None, None), (223, "w x " * 80, "en", "s")]
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d[0], 1) for d in docs[:100]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items, labels


def test_against_brute_force(spark):
    folder, docs, items, labels = tables(spark)
    ok = plain_verdicts([(k, lang, t) for k, t, lang, _ in docs], labels)
    kept = [d for d in docs if ok[d[0]]]
    groups = plain_components([(d[0], plain_fingerprint(d[1] or "")) for d in kept])
    kept = [d for d, g in zip(kept, groups) if d[0] == g]
    kept = [d for d in kept if not plain_matches(d[1], items)]
    ranks = bpe.parse_ranks(bpe.read_vocabulary(PATH))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, t, _, _ in kept:
        for s, _, e in reversed(plain_base(t)):
            if not any(a <= s and e <= b and (a, b) != (s, e) for a, _, b in plain_base(t)):
                t = t[:s] + "[SECRET]" + t[e:]
        want[k] = library.encode_ordinary(t)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert 220 in got and not got.keys() & {200, 201, 210, 211, 221, 222, 223}
    assert credentials.KINDS[0] == "assign" and not re.search("abcdef0123", library.decode(got[220]))


def test_stages_keep_the_columns(spark):
    folder, *_ = tables(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_kept", F.lit("extra"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


