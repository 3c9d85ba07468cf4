import random
import re

import numpy as np
import pytest

from wattspark.llm import minmax

WORDS = [f"w{i}" for i in range(4000)]


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    first = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            first[root(i)] = min(k, first.get(root(i), k))
    return sorted(repr((k, len(s), c, k == c)) for i, ((k, _), s) in enumerate(zip(rows, sets)) for c in [first.get(root(i))])


def edited(r, words, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in words)


def documents(seed):
    """Families of copies with more and more edits, so that similarities lie on both sides of the limit."""
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(WORDS) for _ in range(r.choice([5, 40, 150, 400]))]
        for share in (0, 0, 0.01, 0.03, 0.05, 0.06, 0.08, 0.2):
            rows.append((n, edited(r, base, share)))
            n += 1
    rows += [(900, rows[0][1].upper()), (901, "  " + rows[1][1].replace(" ", "\n")), (902, None), (903, ""), (904, " \t"), (905, "one"), (906, "ONE"), (907, "one two")]
    rows += [(None, rows[8][1]), (None, "a text without any id"), (None, "a text without any id"), (0, rows[0][1]), (0, rows[20][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds", [4, 0])
def test_groups_against_brute_force(spark, rounds):
    rows = documents(rounds)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, sid string, comp int")
    found = minmax.near_duplicates(docs, rounds=rounds)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found.collect()) == plain_groups(rows)


def test_a_large_group_of_near_copies(spark):
    """Hundreds of edited copies of one text, many of them linked only through others."""
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = [(i, edited(r, base, r.choice([0.01, 0.03, 0.05, 0.08]))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = minmax.near_duplicates(docs).collect()
    assert sorted(repr((x.doc_id, x.n_shingles, x.component_id, x.kept)) for x in found) == plain_groups(rows)


def test_empty_table(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    """Both ends of each permutation agree as often as the similarity says."""
    r = np.random.default_rng(3)
    x = r.integers(0, 2**64, 1000, dtype=np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])  # similarity 0.8
    agree = [np.mean(p == q) for p, q in zip(minmax.signature(a), minmax.signature(b))]
    assert all(abs(v - 0.8) < 0.1 for v in agree)
    assert len(minmax.band_keys(*minmax.signature(a))) == minmax.BANDS


def test_parity_bound():
    r = np.random.default_rng(4)
    for _ in range(50):
        x = r.integers(0, 2**64, 700, dtype=np.uint64)
        a, b = np.unique(x[: r.integers(1, 700)]), np.unique(x[r.integers(0, 600) :])
        differ = np.bitwise_count((minmax.parities(a) ^ minmax.parities(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))
