import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wattspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Token by token, document by document."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, held = [], Counter()
    for key, text in rows:
        groups, ids_a, ids_b = [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelt_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            spelt_b = [piece(i) for i in ids_b]
            if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
                ids_a, ids_b, spelt_a, spelt_b = [], [], [], []
            at = lambda spelt: [sum(map(len, spelt[: i + 1])) for i in range(len(spelt))]
            ends_a, ends_b = at(spelt_a), at(spelt_b)
            start = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= cut], [i for i, e in zip(ids_b, ends_b) if start < e <= cut]))
                start = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((key, len(ids_a), len(ids_b), len(groups), links, digest))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    return sorted(repr((k, na, nb, ng, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), d)) for k, na, nb, ng, ls, d in out)


def texts():
    r = random.Random(5)
    words = "the tokens Überraschung naïve 日本語 \U0001f600 12345 <s> </s> <|endoftext|> it's   a\tb\n\n x=1; ________ é antidisestablishmentarianism".split(" ")
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(40)]
    return [*made, made[0], made[0], None, "", " ", "\n", "a", "▁", "same same same same", "ﬁ ligature", "x" * 5000, "é" * 700]


def digest(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def rows():
    return [(None if i % 9 == 4 else i % 30, t) for i, t in enumerate(texts())]


def test_against_plain_version(spark):
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in rows()], "doc_id long, text string, n_a int, plane string").repartition(5)
    found = alignment.align(docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert digest(found) == plain(rows())
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_pair_counts_of_many_segments(spark, monkeypatch):
    """Segments, blocks and slices change nothing; links count with their multiplicity."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(2)
    index = alignment.build_index(docs, A, B)
    whole = {r.pair: (r.docs, r.links) for r in alignment.pair_counts(index).collect()}
    assert sum(n for _, n in whole.values()) == index.where("plane is null").agg({"n_links": "sum"}).first()[0]
    aligner = alignment.Aligner(alignment._read(A), alignment._read(B))
    given = [t or "" for t in texts()]
    *_, keys, counts = aligner.align(given)
    monkeypatch.setattr(alignment, "SLICE", 7)
    *_, keys_7, counts_7 = aligner.align(given)
    assert (keys == keys_7).all() and (counts == counts_7).all()
    held = Counter((keys >> alignment.POS_BITS).tolist())
    assert {p: n for p, (n, _) in whole.items()} == dict(held)


@pytest.mark.parametrize("docs", [1, 16, 1000, 65536])
def test_bitmaps(docs):
    r = np.random.default_rng(docs)
    sets = [np.sort(r.choice(docs, size=r.integers(1, docs + 1), replace=False)) for _ in range(20)] + [np.array([docs - 1])]
    n = np.array([len(s) for s in sets])
    packed = alignment.compress(np.concatenate(sets).astype(np.uint16), n, docs)
    assert packed.nbytes <= 21 * (2 * -(-docs // 16) + 8)
    totals = np.zeros((1, docs), np.int64)
    alignment.spread(packed.to_pylist(), n, np.arange(1, 22)[None, :], totals)
    want = np.zeros(docs, np.int64)
    for i, s in enumerate(sets):
        want[s] += i + 1
    assert (totals[0] == want).all()


def test_ids_by_rank_are_those_of_the_library():
    """The faster encoder of A gives the ids of the tokenizers library; other files take the library."""
    aligner = alignment.Aligner(alignment._read(A), alignment._read(B))
    r = random.Random(8)
    given = ["".join(r.choice(["a", "B", "é", "1", "'s", " ", " ", "  ", "\n", "\t", "\u3000", "\x1c", "\x85", "!", "日", "<|endoftext|>", "२", "ǅ", "\U0001f600"]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    given += ["".join(chr(c) for c in range(k, k + 200) if not 0xD800 <= c <= 0xDFFF) for k in range(1, 0x30000, 200)]
    assert aligner.ranked is not None
    by_rank = [x.tolist() for x in aligner._encode_a(given)]
    aligner.ranked = None
    assert [x.tolist() for x in aligner._encode_a(given)] == by_rank
    other = json.loads(alignment._read(A))
    other["model"]["merges"] = other["model"]["merges"][::-1]
    assert alignment._by_rank(other) is None
