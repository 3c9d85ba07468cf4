import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattspark.operators.features import power_features
from wattspark.operators.outliers import SKETCH_RANK, iqr_outliers_global, iqr_outliers_grouped, sketched_fences, value_sketches
from wattspark.operators.quantiles import quantiles
from wattspark.operators.stats import box_stats


def check(spark, pdf, accuracy=10_000):
    qs = [0.05, 0.25, 1 / 3, 0.5, 0.95]
    names = [f"q{i}" for i in range(len(qs))]
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", qs, names, accuracy).toPandas()
    want = pdf.dropna().groupby("k")["v"].quantile(qs).unstack()
    got = got.set_index("k").sort_index()
    assert list(got.index) == list(want.index)
    assert np.allclose(got[names].to_numpy(), want.to_numpy(), rtol=0, atol=1e-9)
    assert (got["n"] == pdf.dropna().groupby("k").size()).all()


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_one_group_holds_most_rows(spark, accuracy):
    rng = np.random.default_rng(1)
    k = np.where(rng.random(30_000) < 0.6, 0, rng.integers(1, 40, 30_000))
    v = np.where(rng.random(30_000) < 0.3, 85.0, rng.gamma(2.0, 40.0, 30_000))  # a third are copies
    check(spark, pd.DataFrame({"k": k, "v": v}), accuracy)


def test_tiny_groups_and_missing_values(spark):
    pdf = pd.DataFrame({"k": [1, 2, 2, 3, 3, 3, 4, 4], "v": [5.0, 1.0, 2.0, 7.0, 7.0, 7.0, np.nan, 3.0]})
    check(spark, pdf)


def test_many_rows_against_builtin(spark):
    df = spark.range(2_000_000).select(
        F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e6).alias("v")
    )
    got = quantiles(df, ["k"], "v", [0.25, 0.8], ["a", "b"]).first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.8)))).first()[0]
    assert got.a == pytest.approx(want[0], abs=1e-9) and got.b == pytest.approx(want[1], abs=1e-9)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, power_watts double")
    assert quantiles(df, [], "power_watts", [0.5], ["m"]).first().m is None
    assert iqr_outliers_global(df).count() == 0


def test_fences_are_strict_and_constant_power_has_none(spark):
    # quartiles 1 and 3, so the upper fence is exactly 6
    rows = [("a", float(x)) for x in (0, 1, 2, 3, 6)] + [("b", 9.0)] * 4
    df = spark.createDataFrame(rows, "k string, power_watts double")
    assert iqr_outliers_grouped(df, ["k"]).count() == 0
    more = df.union(spark.createDataFrame([("b", 9.5)], df.schema))
    assert [r.power_watts for r in iqr_outliers_grouped(more, ["k"]).collect()] == [9.5]


def test_box_whiskers_end_inside_the_fences(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 100)], "k string, power_watts double")
    row = box_stats(df, ["k"]).first()
    assert (row.whisker_low, row.whisker_high, row.n_fliers, row.n) == (1.0, 5.0, 1, 6)


@pytest.mark.parametrize("piece", ["hour", "day"])
def test_split_history_equals_one_window(spark, piece):
    rng = np.random.default_rng(2)
    n = 3000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 6 * 86_400, n)), unit="s")
    gpu = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"gpu_id": gpu, "timestamp": ts, "row_id": np.arange(n), "power_watts": rng.random(n) * 400})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = power_features(df, piece=piece).toPandas().sort_values("row_id")
    by = pdf.sort_values(["timestamp", "row_id"]).groupby("gpu_id")["power_watts"]
    roll = by.transform(lambda x: x.rolling(5, min_periods=1).mean()).sort_index()
    delta = by.diff().fillna(0).sort_index()
    assert len(got) == n
    assert np.allclose(got.rolling_mean_power.to_numpy(), roll.to_numpy())
    assert np.allclose(got.power_delta.to_numpy(), delta.to_numpy())


def test_sketched_fences_of_a_range_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 * 86_400, n), unit="s")
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "timestamp": ts, "power_watts": rng.gamma(2.0, 40.0, n)})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    df = df.unionByName(spark.createDataFrame([("a", None, 1.0), ("a", None, None)], df.schema))
    got = sketched_fences(value_sketches(df, ["g"]), ["g"], "2024-01-03", "2024-01-06").toPandas().set_index("g")
    inside = pdf[(pdf.timestamp >= "2024-01-03") & (pdf.timestamp < "2024-01-06")]
    for g, rows in inside.groupby("g"):
        v = rows.power_watts.to_numpy()
        assert got.n[g] == len(v)
        for q, p in ((got.q1[g], 0.25), (got.q3[g], 0.75)):
            assert abs((v <= q).mean() - p) <= SKETCH_RANK + 1 / len(v)
    assert sketched_fences(value_sketches(df.limit(0), ["g"]), ["g"]).count() == 0
