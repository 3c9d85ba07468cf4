import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattspark.operators.stats import POISSON, host_type_density, timeline_band


def readings(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "row_id": np.arange(n),
            "hostname": np.where(rng.random(n) < 0.8, "hot", "b"),
            "gpu_type": rng.choice(["A100", "H100"], n),
            "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5 * 3600, n), unit="s"),
            "power_watts": rng.gamma(2.0, 40.0, n),
        }
    )


def frame(spark, pdf):
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    odd = [(10**6, "hot", "A100", None, None), (10**6 + 1, "hot", "A100", None, float("nan")), (10**6 + 2, "one", "A100", None, 5.0)]
    return df.unionByName(spark.createDataFrame(odd, df.schema))


def test_density_is_near_the_kernel_sum_over_all_rows_and_integrates_to_one(spark):
    pdf = readings()
    got = host_type_density(frame(spark, pdf)).toPandas()
    assert len(got) == 4 * 100  # a host with one value has no curve
    for (host, kind), own in got.groupby(["hostname", "gpu_type"]):
        v = pdf[(pdf.hostname == host) & (pdf.gpu_type == kind)].power_watts.to_numpy()
        own = own.sort_values("point")
        h = v.std(ddof=1) * len(v) ** -0.2
        z = (own.power.to_numpy()[:, None] - v[None]) / h
        want = np.exp(-0.5 * z * z).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose(own.density.to_numpy(), want, rtol=0, atol=0.005 * want.max())
        assert abs(np.trapezoid(own.density, own.power) - 1) < 0.03
    assert host_type_density(frame(spark, pdf).limit(0)).count() == 0


def test_band_equals_the_replicates_one_by_one(spark):
    pdf = readings(600)
    got = timeline_band(frame(spark, pdf), replicates=20).where("bucket IS NOT NULL").toPandas()
    pdf["bucket"] = pdf.timestamp.dt.floor("h")

    def weight(row, r):
        draw = int(hashlib.md5(f"{row}|{r // 8}".encode()).hexdigest()[4 * (r % 8) :][:4], 16)
        return sum(draw >= c for c in POISSON)

    assert len(got) == pdf.groupby(["hostname", "bucket"]).ngroups
    for x in got.itertuples():
        own = pdf[(pdf.hostname == x.hostname) & (pdf.bucket == x.bucket)]
        means = []
        for r in range(20):
            w = np.array([weight(i, r) for i in own.row_id])
            if w.sum():
                means.append((own.power_watts.to_numpy() * w).sum() / w.sum())
        assert x.n == len(own) and abs(x.avg_power - own.power_watts.mean()) < 1e-9
        assert np.allclose([x.band_low, x.band_high], np.quantile(means, [0.025, 0.975]))


def test_weights_are_poisson(spark):
    draws = np.arange(65536)
    weights = (draws[:, None] >= np.array(POISSON)).sum(axis=1)
    assert abs(weights.mean() - 1) < 1e-3 and abs(weights.var() - 1) < 2e-3
    assert timeline_band(frame(spark, readings(10)).limit(0), replicates=3).count() == 0
