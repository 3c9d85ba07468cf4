import random

import pytest

from wattspark.operators import boxtree, density


def points(r, n, d):
    """Clumps, exact copies and far rows; whole numbers, so that distances tie."""
    spots = [[r.randint(0, 12) for _ in range(d)] for _ in range(n)]
    return spots + spots[: n // 4] + [[5] * d] * 300 + [[1000 + i] * d for i in range(5)]


@pytest.mark.parametrize("d,n", [(1, 40), (2, 900), (3, 2500)])
def test_nearest_against_brute_force(spark, d, n, monkeypatch):
    monkeypatch.setattr(boxtree, "PART_ROWS", 300)  # several partitions and levels
    r = random.Random(d)
    known = [(i, *map(float, p), i % 5) for i, p in enumerate(points(r, n, d))]
    xs = [f"x{i}" for i in range(d)]
    shape = ", ".join(f"{x} double" for x in xs)
    tree = boxtree.build(spark.createDataFrame([*known, (-1, *[None] * d, 9)], f"key long, {shape}, label int"), d, ["key", "label"])
    assert all(level.count() <= boxtree.TOP for level in tree.levels[:1]) and tree.points.count() == len(known)
    asked = [(i, *[r.randint(-3, 15) + r.choice([0.0, 0.5]) for _ in range(d)]) for i in range(120)]
    rows = spark.createDataFrame([*asked, (500, *[None] * d), (501, *[float("nan")] * d)], f"row long, {shape}")
    got = {x.row: (x.best.d2, x.best.key, x.best.label) for x in boxtree.nearest(tree, rows, "row", xs, 2.0, ["key", "label"]).collect()}
    want = {}
    for i, *q in asked:
        d2, key, label = min((sum((a - b) ** 2 for a, b in zip(q, p)), k, c) for k, *p, c in known)
        if d2 <= 4.0:
            want[i] = (d2, key, label)
    assert got == want


def test_empty_tree(spark):
    tree = boxtree.build(spark.createDataFrame([], "x0 double, key long"), 1, ["key"])
    rows = spark.createDataFrame([(1, 0.0)], "row long, x0 double")
    assert boxtree.nearest(tree, rows, "row", ["x0"], 1.0, ["key"]).count() == 0


def test_labels_of_a_table_without_clusters(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None)], "row_id long, a double")
    known = spark.createDataFrame([(1, 0.0, -1)], "row_id long, a double, cluster int")
    assert sorted((r.row_id, r.cluster) for r in density.nn_label_join(rows, known, ["a"], 1.0).collect()) == [(1, -1), (2, -1)]
