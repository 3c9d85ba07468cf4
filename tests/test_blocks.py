import numpy as np
import pandas as pd

from wattspark.operators import blocks, density
from wattspark.operators.components import smallest_linked


def test_k_distance_sends_few_rows_on_and_merges_rows_of_one_id(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.random((2000, 2)), rng.random((400, 2)) * 0.01, [[40.0, 40.0]], [[0.5, 0.5]] * 30])
    ids = np.arange(len(x))
    ids[100:110] = 7  # one id of several rows: its distances are taken together
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "row_id": ids}))
    df = df.unionByName(spark.createDataFrame([(None, 0.5, 9999)], "a double, b double, row_id long"))
    sent, plain = [], blocks.together

    def counted(a, b, keys, tasks):
        if "kd2" in a.columns and "_t" not in a.columns:
            sent.append(a.count())
        return plain(a, b, keys, tasks)

    monkeypatch.setattr(blocks, "together", counted)
    got = density.k_distance(df, ["a", "b"], "row_id", 20, block=200).toPandas().set_index("row_id").k_dist
    assert np.isnan(got.pop(9999))  # a row without a whole position
    assert sent and sent[0] < 3 * len(x)  # before, every row met every block near its own
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in np.unique(ids):
        assert np.isclose(got[i], np.sort(d[ids == i].ravel())[19])
    assert len(got) == len(np.unique(ids))


def test_own_lists_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((1500, 3))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "row_id": range(len(x))}))
    sides, plain = [], blocks.together

    def seen(a, b, keys, tasks):
        sides.append(a.columns)
        return plain(a, b, keys, tasks)

    monkeypatch.setattr(blocks, "together", seen)
    got = density.k_distance(df, ["a", "b", "c"], "row_id", 20, block=150).toPandas().set_index("row_id").k_dist
    assert sides and not any("_d" in s for s in sides)  # before, each point that went on was shuffled with its list
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 19]
    assert np.allclose(got.loc[range(len(x))], d)


def test_runs_are_broadcast_and_boxes_hashed(spark):
    points = spark.range(50).selectExpr("string(id % 2) AS part", "id", "double(id) AS x0", "double(id % 7) AS x1")
    runs = density._constant_runs(points, {"0": ("0", 0.5), "1": ("1", 0.25)})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan(points.join(runs, "part"))  # before, a part was one task
    hashed, sorted_ = (density._boxes(points, ["part"], 2, unique) for unique in (True, False))
    assert "SortAggregate" not in plan(hashed)
    as_set = lambda df: {str(r.asDict(True)) for r in df.select("part", "x0_lo", "x0_hi", "x1_lo", "x1_hi", "rep").collect()}
    assert as_set(hashed) == as_set(sorted_)


def test_smallest_linked():
    a, b = np.array([5, 1, 8, 7]), np.array([4, 4, 9, 8])
    assert smallest_linked(10, a, b).tolist() == [0, 1, 2, 3, 1, 1, 6, 7, 7, 7]
