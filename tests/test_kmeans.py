import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattspark.operators import kmeans, projection, scaling


def lloyd(x, power, k, rounds):
    cuts = [np.quantile(power, i / k) for i in range(1, k)]
    c = np.searchsorted(cuts, power, side="left")
    cent = np.array([x[c == j].mean(0) if (c == j).any() else np.full(x.shape[1], np.nan) for j in range(k)])
    for step in range(rounds + 1):
        d = np.nan_to_num(((x[:, None] - cent[None]) ** 2).sum(2), nan=np.inf)
        c = d.argmin(1)
        if step < rounds:
            cent = np.array([x[c == j].mean(0) if (c == j).any() else cent[j] for j in range(k)])
    order = sorted((power[c == j].mean(), j) for j in range(k) if (c == j).any())
    rank = {j: r for r, (_, j) in enumerate(order)}
    return np.array([rank[j] for j in c])


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "row_id": np.arange(n),
            "g": rng.choice(["a", "b"], n, p=[0.8, 0.2]),
            "power_watts": rng.gamma(2, 40, n),
            "hour": rng.integers(0, 24, n).astype(float),
        }
    )


def test_deterministic_form_equals_numpy(spark):
    pdf = data()
    got = kmeans.kmeans_det(spark.createDataFrame(pdf), ["power_watts", "hour"]).orderBy("row_id").toPandas()
    x, power = pdf[["power_watts", "hour"]].to_numpy(), pdf.power_watts.to_numpy()
    want = lloyd(x, power, 3, 200)
    assert (want == lloyd(x, power, 3, 300)).all()
    assert (got.cluster.to_numpy() == want).all()
    assert (want != lloyd(x, power, 3, 6)).any()  # a limit of six rounds would be wrong here


def test_edge_cases_end(spark):
    one = spark.createDataFrame([(i, 5.0, 1.0) for i in range(20)], "row_id long, power_watts double, hour double")
    assert {r.cluster for r in kmeans.kmeans_det(one, ["power_watts", "hour"]).collect()} == {0}
    assert {r.cluster for r in kmeans.kmeans_det(one, ["power_watts"], k=1).collect()} == {0}


def test_groups_move_together_and_small_groups_are_left_out(spark):
    pdf = data(300, 1)
    tiny = pd.DataFrame({"row_id": [900, 901], "g": "tiny", "power_watts": [1.0, 2.0], "hour": [0.0, 1.0]})
    df = spark.createDataFrame(pd.concat([pdf, tiny]))
    got = kmeans.kmeans_by_group(df, ["g"], ["power_watts", "hour"]).toPandas().set_index("row_id")
    assert got.loc[[900, 901], "cluster"].tolist() == [-1, -1]
    assert set(got.loc[[900, 901], "cluster_label"]) == {"None"}
    for g in ("a", "b"):
        part = pdf[pdf.g == g]
        x = part[["power_watts", "hour"]].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        assert (got.loc[part.row_id, "cluster"].to_numpy() == lloyd(z, part.power_watts.to_numpy(), 3, 200)).all()
    means = got[got.g == "a"].groupby("cluster_label").power_watts.mean()
    assert means["Low usage / idle cluster"] < means["Medium usage cluster"] < means["High spike cluster"]


def test_random_starts_are_at_least_as_good(spark):
    df = spark.createDataFrame(data())
    rows, cost = kmeans.kmeans(df, ["power_watts", "hour"], seeds=range(42, 45))
    det = kmeans.kmeans_det(df, ["power_watts", "hour"])
    fixed = kmeans.inertia(kmeans.centroid_distance(det, ["power_watts", "hour"])).first().inertia
    assert rows.select("cluster").distinct().count() == 3
    assert cost <= fixed * 1.05


def test_constant_feature_is_zero_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    got = [tuple(r) for r in scaling.standardize(df, ["a", "b"])[0].orderBy("a").collect()]
    assert got == [(1.0, 7.0, -1.0, 0.0), (3.0, 7.0, 1.0, 0.0)]


@pytest.mark.parametrize("block", [50, 4000])
def test_silhouette_exact(spark, block):
    pdf = data(220, 3)
    pdf["cluster"] = (pdf.power_watts > 80).astype(int)
    pdf.loc[5, "cluster"] = 2  # a cluster of one row scores 0
    x, c = pdf[["power_watts", "hour"]].to_numpy(), pdf.cluster.to_numpy()
    for squared in (False, True):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        d = d if squared else np.sqrt(d)
        score = []
        for i in range(len(x)):
            own = (c == c[i]).sum()
            if own == 1:
                score.append(0.0)
                continue
            a = d[i, c == c[i]].sum() / (own - 1)
            b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
            score.append((b - a) / max(a, b))
        df = spark.createDataFrame(pdf)
        if squared:
            got = kmeans.silhouette_sq(df, ["power_watts", "hour"]).first().silhouette
        else:
            got = kmeans.silhouette(df, ["power_watts", "hour"], "cluster", "row_id", block).first().silhouette
        assert got == pytest.approx(np.mean(score), abs=1e-9)


def test_silhouette_sends_a_row_to_few_tasks_and_keeps_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 20_000
    pdf = pd.DataFrame({"row_id": [str(i) for i in range(n)], "a": rng.random(n), "b": rng.integers(0, 5, n) * 1.0})
    pdf["cluster"] = (pdf.a * 3).astype(int)
    sent, plain = [], kmeans.together

    def counted(a, b, keys, tasks):
        sent.append(a.count() + b.count())
        return plain(a, b, keys, tasks)

    monkeypatch.setattr(kmeans, "together", counted)
    got = kmeans.silhouette(spark.createDataFrame(pdf), ["a", "b"], "cluster", "row_id").first().silhouette
    assert sent and sent[0] <= 25  # pairs of whole blocks; before, each row went to every block as a row of its own, on both sides
    x, c = pdf[["a", "b"]].to_numpy(), pdf.cluster.to_numpy()
    score = 0.0
    for s in range(0, n, 500):
        d = np.sqrt(((x[s : s + 500, None] - x[None]) ** 2).sum(2))
        sums = np.stack([d[:, c == g].sum(1) for g in range(3)], axis=1)
        size, own = np.bincount(c), c[s : s + 500]
        inside = sums[np.arange(len(own)), own] / (size[own] - 1)
        means = sums / size
        means[np.arange(len(own)), own] = np.inf
        near = means.min(1)
        score += ((near - inside) / np.maximum(near, inside)).sum()
    assert got == pytest.approx(score / n, abs=1e-9)

    # A row without a class counts with 0 and is in nobody's sums; rows of one id are one; a row without an id is no row.
    rows = [("a", 0.0, 0), ("b", 1.0, 0), ("c", 5.0, 1), ("c", 7.0, 1), ("d", None, None), (None, 5.0, 1)]
    got = kmeans.silhouette(spark.createDataFrame(rows, "row_id string, x double, cluster int"), ["x"], "cluster", "row_id", 2).first().silhouette
    near, own = np.array([17 / 3, 14 / 3, 11 / 2]), np.array([1.0, 1.0, (2 + 0 + 4) / 2])
    near[2] = ((5 + 4) + (7 + 6)) / 2
    assert got == pytest.approx((((near - own) / np.maximum(near, own)).sum() + 0.0) / 4, abs=1e-9)


def test_sample_is_exact_and_reproducible(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    a = scaling.sample_n(df, "row_id", 500)
    b = scaling.sample_n(df.repartition(7), "row_id", 500)
    plain = df.orderBy(F.md5(F.col("row_id").cast("string")), "row_id").limit(500)
    ids = {r.row_id for r in plain.collect()}
    assert ids == {r.row_id for r in a.collect()} == {r.row_id for r in b.collect()}
    assert scaling.sample_n(df, "row_id", 20_001).count() == 20_000


def test_projection_equals_numpy(spark):
    pdf = data(300, 4)
    pdf["w"] = pdf.power_watts * 0.5 + pdf.hour
    cols = ["power_watts", "hour", "w"]
    x = pdf[cols].to_numpy()
    x = x - x.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    df = spark.createDataFrame(pdf)
    shares = [r.share for r in projection.pca_explained(df, cols).orderBy("component").collect()]
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
    out = projection.pca_2d(df, cols).agg(F.var_pop("pca1"), F.var_pop("pca2"), F.covar_pop("pca1", "pca2")).first()
    assert np.allclose(list(out), [s[0] ** 2 / 300, s[1] ** 2 / 300, 0.0], atol=1e-6)
