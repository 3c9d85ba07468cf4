import math
import random
from collections import Counter

from pyspark.sql import functions as F

from wattspark.llm import quality

BLANK = " \t\n\x0b\x0c\r"


def plain_counts(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def texts():
    r = random.Random(2)
    out = [None, "", " \n ", "a", "a a a a", "x y z x y z", "é #| b\x1fc\n\n é #| b\x1fc", "same\nsame\n\nsame", "word " * 30000]
    return out + ["".join(r.choice("ab \n#é\x0b") for _ in range(r.randint(0, 300))) for _ in range(300)]


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = spark.createDataFrame(rows, "i long, text string").select("i", quality.measure().alias("m")).orderBy("i").collect()
    for (_, t), r in zip(rows, got):
        assert tuple(r.m)[:5] == plain_counts(t)


def test_tail_is_exact():
    for n, p in ((1, 0.3), (7, 0.02), (40, 0.1)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.tail(k, n, p) - want) < 1e-12


def test_certified_step():
    # 0, 0, 40 of 4000 good rejected: the third step cannot be certified at 0.5 %.
    assert quality.certified([0, 0, 40], 4000, 0.005, 0.001) == 1
    assert quality.certified([0, 40, 0], 4000, 0.005, 0.001) == 0  # stops at the first failure
    assert quality.certified([0, 0, 0], 100, 0.005, 0.001) == -1  # too few labels
    assert quality.certified([0], 0, 0.005, 0.001) == -1


def test_least_labels():
    n = quality.least_labels(0.02, 0.05 / 4)
    assert n == 217
    assert quality.certified([0], n, 0.02, 0.05 / 4) == 0
    assert quality.certified([0], n - 1, 0.02, 0.05 / 4) == -1


def test_most_useful_cutoff():
    assert quality.most_useful([0, 0, 40], [10, 25, 50]) == 1
    assert quality.most_useful([0, 0, 0], [5, 5, 5]) == 0  # the most lenient of equal ones
    assert quality.most_useful([1, 3], [1, 2]) == -1  # more good than bad documents
    assert quality.most_useful([], []) == -1


def test_steps_tighten_every_rule_to_its_end():
    for rule, (_, cuts) in quality.RULES.items():
        places = [quality.place(rule, t) for t in range(quality.STEPS)]
        assert places == sorted(places) and places[0] == 0 and places[-1] == len(cuts) - 1
        assert cuts == sorted(cuts, reverse=True)


def plain_verdicts(rows, labels, alpha=0.02, delta=0.05):
    counts = {}
    for key, lang, text in rows:
        n, chars, sym, dup, rep = plain_counts(text)
        lines = sum(bool(line.strip(BLANK)) for line in (text or "").split("\n"))
        counts[key] = (lang, n < 50 or 100 * rep > 50 * n, {"symbols_per_word": sym / max(n, 1), "repeated_words": rep / max(n, 1), "duplicate_lines": dup / max(lines, 1), "word_length": chars / max(n, 1)})
    held = [(counts[k], q > 0) for k, q in labels if k in counts and q is not None and not counts[k][1]]
    strata = {c[0] for c, _ in held}
    cutoffs = {}
    for s in strata:
        own = [(c[2], good) for c, good in held if c[0] == s]
        n = sum(good for _, good in own)
        corner = None
        for t in range(9):
            joint = {rule: cuts[math.ceil((t + 1) * len(cuts) / 9) - 1] for rule, (_, cuts) in quality.RULES.items()}
            g = sum(any(v[rule] > joint[rule] for rule in joint) for v, good in own if good)
            p = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log(1 - alpha)) for i in range(g + 1))
            if n == 0 or p > delta / len(strata):
                break
            corner = joint
        for rule, (_, cuts) in quality.RULES.items():
            best = 0
            for cut in cuts:
                if corner is None or cut < corner[rule]:
                    break
                g = sum(v[rule] > cut for v, good in own if good)
                b = sum(v[rule] > cut for v, good in own if not good)
                if b - g > best:
                    best, cutoffs[s, rule] = b - g, cut
    return {k: not bad and not any(v[r] > cutoffs.get((lang, r), math.inf) for r in quality.RULES) for k, (lang, bad, v) in counts.items()}


def corpus():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(6000):
        good = r.random() < 0.8
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(45, 70))]
        if not good:
            words = [w + "###" * (r.random() < 0.7) for w in words]
        rows.append((i, r.choice(["aa", "aa", "aa", "bb", None]), " ".join(words)))
        labels.append((i, int(good)))
    labels += [(10**9, 1), (5, None)]
    return rows, labels


def test_verdicts_against_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, lang string, text string, stratum string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, lab).select("doc_id", "kept").collect()}
    want = plain_verdicts(rows, labels)
    assert got == want
    assert not all(want.values())
    good = [k for k, q in labels if q == 1 and k in want and 50 <= len(rows[k][2].split())]
    assert sum(want[k] for k in good) / len(good) > 0.98


def test_small_strata_certify(spark):
    """Strata of 250 good labels: the bad documents go, and at most a fiftieth of the good ones."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        good = i % 6 > 0
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
        rows.append((i, "abcd"[i // 6 % 4], " ".join(words if good else [w + "#" * r.randint(0, 3) for w in words])))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x.doc_id: x.kept for x in quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == plain_verdicts(rows, labels)
    for s in "abcd":
        own = [(i, q) for i, q in labels if rows[i][1] == s]
        assert not any(got[i] for i, q in own if not q)
        assert sum(got[i] for i, q in own if q) >= 0.98 * sum(q for _, q in own)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "aa", "w " * 60), (3, "aa", " ".join(map(str, range(60))))], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, none).collect()}
    assert got == {1: False, 2: False, 3: True}
    assert quality.quality_verdicts(docs.where(F.lit(False)), none).count() == 0
