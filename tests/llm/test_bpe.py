import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from wattspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.parse_ranks(bpe.read_vocabulary(PATH))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(7)
    letters = " '  \n\tsrevmltdx1é½中۵!#\x1c\x85\xa0 　aaaabthe.,"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return texts + ["", "a" * 5000, "ab" * 3000, " " * 1000, "\n" * 77 + "x", "thethethe" * 300, "!" * 4000, "é" * 3000, "the " * 20000]


def test_ids_are_those_of_the_library(library):
    texts = odd_texts()
    got = bpe.encode_array(pa.array(texts), bpe.read_vocabulary(PATH)).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]


def test_replay_equals_the_plain_loop():
    ranks = bpe.parse_ranks(bpe.read_vocabulary(PATH))
    replay = bpe.Replay(ranks)
    r = random.Random(1)
    pieces = list({"".join(r.choice("thein asou") for _ in range(r.randint(1, 25))).encode() for _ in range(3000)})
    ids, ends = replay.encode(pa.array(pieces, pa.binary()))
    for i, piece in enumerate(pieces):
        plain = [ranks[piece]] if piece in ranks else replay.plain(piece)
        assert ids[ends[i] : ends[i + 1]].tolist() == plain


def test_blocks_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20)
    texts = ["the cat, the hat.", "a new day\nis here", None, "the  cat, again!", "", "x" * 100] * 3
    got = bpe.encode_array(pa.array(texts), bpe.read_vocabulary(PATH)).to_pylist()
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_array_wise_and_single_merges_agree(library, monkeypatch):
    texts = odd_texts()[:800]
    want = [library.encode_ordinary(t) for t in texts]
    for frequent in (1, 10**9):
        monkeypatch.setattr(bpe, "FREQUENT", frequent)
        assert bpe.encode_array(pa.array(texts), bpe.read_vocabulary(PATH)).to_pylist() == want


def test_round_trip_and_defined_cases(spark, library):
    rows = [(1, "Hé  said: 'tis 12 o'clock\n\n中文", "x"), (2, None, "y"), (3, "", "z"), (1, "Hé  said: 'tis 12 o'clock\n\n中文", "x"), (None, "tie tie", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).withColumn("sha", bpe.ids_sha256("ids")).collect()
    assert len(coded) == 5
    for r in coded:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert r.sha == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0
