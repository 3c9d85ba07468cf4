import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattspark.operators import density
from wattspark.operators.components import connected_components, merge_components


def brute(x, eps, min_pts):
    d2 = np.zeros((len(x), len(x)))
    for f in range(x.shape[1]):
        diff = x[:, f, None] - x[None, :, f]
        d2 += diff * diff
    near = d2 <= eps * eps
    core = near.sum(1) >= min_pts
    label = np.full(len(x), -1)
    cluster = 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], stack = cluster, [i]
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.nonzero(near[j] & (label == -1))[0]:
                    label[m] = cluster
                    stack.append(m)
        cluster += 1
    return label


def frame(spark, x):
    cols = [f"f{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf["row_id"] = np.arange(len(x))
    return spark.createDataFrame(pdf).repartition(5, "f0"), cols


def blobs(seed, d, n=700):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (m, d)) for c, s, m in ((0, 0.05, n // 2), (1, 0.2, n // 4), (2, 0.6, n // 4))]
    x = np.vstack(parts)
    x[: n // 6] = x[0]  # many copies of one point
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed,d,eps", [(1, 3, 0.15), (3, 2, 0.1)])
def test_dbscan_equals_brute_force(spark, seed, d, eps):
    x = blobs(seed, d)
    df, cols = frame(spark, x)
    got = density.dbscan(df, cols, "row_id", eps, min_pts=10).orderBy("row_id").toPandas()
    assert (got.cluster.to_numpy() == brute(x, eps, 10)).all()


def test_distance_exactly_eps_counts_and_border_goes_to_the_lower_cluster(spark):
    left, right = [[0.0, i * 0.25] for i in range(4)], [[2.0, i * 0.25] for i in range(4)]
    x = np.array([*right, *left, [1.0, 0.0]])  # the last point is exactly 1 from both groups
    df, cols = frame(spark, x)
    got = density.dbscan(df, cols, "row_id", 1.0, min_pts=4).orderBy("row_id").toPandas()
    assert got.cluster.tolist() == brute(x, 1.0, 4).tolist()
    assert got.cluster.tolist()[-1] == 0


def test_close_but_separate_dense_cells_need_refinement(spark):
    # Two dense slabs whose boxes overlap in two axes and whose gap is around eps.
    rng = np.random.default_rng(5)
    a = np.c_[rng.random(400) * 0.3, rng.random(400) * 3, rng.random(400) * 3]
    b = a + [0.3 + 0.52, 0.011, 0.007]
    x = np.vstack([a, b])
    df, cols = frame(spark, x)
    for eps in (0.53, 0.56):
        got = density.dbscan(df, cols, "row_id", eps, min_pts=5).orderBy("row_id").toPandas()
        assert (got.cluster.to_numpy() == brute(x, eps, 5)).all()


def test_grid_of_radii_in_one_plan(spark):
    x = blobs(7, 3, 400)
    df, cols = frame(spark, x)
    got = density.eps_grid_labels(df, cols, "row_id", [0.1, 0.3], 10).toPandas()
    for eps in (0.1, 0.3):
        mine = got[got.eps == eps].sort_values("row_id")
        assert (mine.cluster.to_numpy() == brute(x, eps, 10)).all()


def test_nearest_label_transfer(spark):
    rng = np.random.default_rng(8)
    x, q = blobs(9, 3, 500), rng.normal(0.8, 0.7, (600, 3))
    label = brute(x, 0.3, 10)
    df, cols = frame(spark, x)
    known = df.join(spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "cluster": label})), "row_id")
    rows, _ = frame(spark, q)
    got = density.nn_label_join(rows, known, cols, 0.3).orderBy("row_id").toPandas().cluster.to_numpy()
    ok = x[label != -1]
    d = np.sqrt(((q[:, None] - ok[None]) ** 2).sum(2))
    want = np.where(d.min(1) <= 0.3, label[label != -1][d.argmin(1)], -1)
    assert (got == want).all()


def test_few_rows_go_the_same_way(spark):
    df, cols = frame(spark, np.random.default_rng(1).random((12, 3)))
    out, chosen = density.dbscan_scalable(df, cols)
    assert out.where("cluster = -1").count() == 12 and not chosen["all"][1]
    x = np.random.default_rng(1).random((49, 3))
    df, cols = frame(spark, x)
    out, chosen = density.dbscan_scalable(df, cols)
    assert (out.orderBy("row_id").toPandas().cluster.to_numpy() == brute(x, chosen["all"][0], 20)).all()
    assert density.dbscan_scalable(df.limit(0), cols)[0].count() == 0


def test_every_row_is_clustered_by_the_tuned_radius(spark):
    x = blobs(11, 3, 800)
    df, cols = frame(spark, x)
    out, chosen = density.dbscan_scalable(df, cols)
    assert (out.orderBy("row_id").toPandas().cluster.to_numpy() == brute(x, chosen["all"][0], 20)).all()
    best, scores = density.dbscan_grid(df, cols, [0.2, 0.4])
    eps = density.eps_grid_select(scores).first().eps
    assert (best.orderBy("row_id").toPandas().cluster.to_numpy() == brute(x, eps, 20)).all()


def test_k_distance_counts_the_point_itself(spark):
    x = np.random.default_rng(3).random((300, 2))
    df, cols = frame(spark, x)
    got = density.k_distance(df, cols, "row_id", 20, block=90).orderBy("row_id").toPandas().k_dist.to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(got, np.sort(d, 1)[:, 19])
    # Copies, a dense heap and far rows: blocks of very different size.
    y = np.concatenate([np.zeros((150, 2)), np.random.default_rng(4).normal(0, 0.01, (300, 2)), np.random.default_rng(5).normal(9, 5, (60, 2))])
    df, cols = frame(spark, y)
    got = density.k_distance(df, cols, "row_id", 20, block=60).orderBy("row_id").toPandas().k_dist.to_numpy()
    assert np.allclose(got, np.sort(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), 1)[:, 19])
    zero = spark.createDataFrame([(0.0,)] * 30, "k_dist double")
    assert density.eps_from_kdist(zero).first().eps == 0.1


def test_components_on_chain_hub_and_loops(spark):
    chain = [("r", i, i + 1) for i in range(100, 160)]
    hub = [("r", 7, i) for i in range(200, 300)]
    edges = spark.createDataFrame(chain + hub + [("s", 7, 200), ("r", 5, 5)], "run string, u long, v long")
    nodes = spark.createDataFrame(
        [("r", i) for i in [5, 7, *range(100, 161), *range(200, 300)]] + [("s", 7), ("s", 200), ("s", 9)],
        "run string, node long",
    )
    labels = connected_components(nodes, edges)
    got = {(r.run, r.node): r.comp for r in labels.collect()}
    assert all(got["r", i] == 100 for i in range(100, 161))
    assert all(got["r", i] == 7 for i in range(200, 300)) and got["r", 5] == 5
    assert (got["s", 200], got["s", 9]) == (7, 9)
    more = merge_components(labels, spark.createDataFrame([("r", 150, 250)], edges.schema))
    assert {r.comp for r in more.where("run = 'r' AND node >= 100").collect()} == {7}


def test_numbering_over_many_id_buckets(spark):
    step = 2**density.ID_BUCKET
    ids = [3, 5, step + 1, 4 * step, 4 * step + 9]
    labels = spark.createDataFrame([("r", i, i) for i in ids], "run string, node long, comp long")
    got = {r.node: r.cluster for r in density._numbered(labels).collect()}
    assert [got[i] for i in ids] == [0, 1, 2, 3, 4]
    assert labels.agg(F.count(F.lit(1))).first()[0] == 5
