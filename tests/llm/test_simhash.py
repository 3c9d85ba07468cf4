import random
import re
import time

import pytest
import xxhash

from wattspark.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint)."""
    least = list(range(len(prints)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    groups = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            groups[root(i)] = min(k, groups.get(root(i), k))
    return [groups.get(root(i)) for i in range(len(prints))]


def test_fingerprints():
    r = random.Random(3)
    texts = ["", "one", "One two", "a b c", " \t\n", "x y z\x1fw q"] + [" ".join(r.choice(["Ab", "cd", "é", "f"]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == plain_fingerprint(t)


def test_chunks_of_long_texts(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("group", [32, 1])
def test_links_are_whole(spark, group):
    r = random.Random(group)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                x ^= 1 << r.randrange(64)
    y = r.getrandbits(64)  # a large group of near copies
    prints |= {y ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    signed = [simhash._signed(x) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, "fp", group=group).collect()
    mask = (1 << 64) - 1
    assert all(((e.u ^ e.v) & mask).bit_count() <= 2 for e in edges)
    want = plain_components([(x, x & mask) for x in signed])
    least = {x: x for x in signed}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for e in edges:
        a, b = sorted((root(e.u), root(e.v)))
        least[b] = a
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(root(x), set()).add(w)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want))


def documents():
    r = random.Random(11)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(50)) for _ in range(300)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split()
        words[r.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, t.upper()))
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "one"), (0, base[0]), (None, base[3]), (None, "lonely text without any id")]


def test_components_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, fp string")
    got = sorted((repr(r.doc_id), r.fp & (1 << 64) - 1, repr(r.component_id)) for r in simhash.near_duplicates(df).collect())
    prints = [(k, plain_fingerprint(t or "")) for k, t in rows]
    want = sorted((repr(k), p, repr(c)) for (k, p), c in zip(prints, plain_components(prints)))
    assert got == want


def test_one_of_each_group_stays(spark):
    rows = documents()
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, _kept string")
    prints = [(k, plain_fingerprint(t or "")) for k, t in rows]
    want = {c for (k, _), c in zip(prints, plain_components(prints)) if k is not None}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_large_group_of_near_copies_stays_linear(spark):
    """A third of all rows in one group: no task makes its pairs."""
    r = random.Random(5)
    y = r.getrandbits(64)
    near = {simhash._signed(y ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 3)))) for _ in range(3000)}
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    start = time.time()
    assert simhash.links(df, "fp").count() <= 70 * len(near)
    assert time.time() - start < 60


def test_repeated_ids_with_other_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    # Id 5 is the smallest of groups A, C and D, and is also in group B, whose smallest is 3.
    data = [(5, text("a")), (9, text("a")), (5, text("b")), (3, text("b")), (5, text("c")), (5, text("d")), (5, text("d")), (5, None), (5, ""), (None, text("a"))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(5, text("a")), (3, text("b")), (5, text("c")), (5, text("d")), (5, ""), (None, text("a"))], key=repr)
