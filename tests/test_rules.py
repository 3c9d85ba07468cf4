import pytest
from pyspark.sql import functions as F

from wattspark.functions import rules
from wattspark.functions.timefeat import daypart_of, time_band_of
from wattspark.operators import behavior, clean, patterns, stats, workload
from wattspark.operators.common import settle
from wattspark.schema import ALL_LABELS, share_column


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


# Published (mean, variance) -> label rows of earlier analyses.
FINAL = [
    (95.29561191107584, 1124.714604233582, "Burst/Unstable"),
    (129.4693005828476, 62.222702294483256, "Moderate Load"),
    (84.87423544349718, 13.683448657909006, "Idle/Low Load"),
    (177.59905870445343, 28.764627612852426, "High Load"),
    (350.0, 2500.0, "Extreme Load"),
    (350.0, None, "Extreme Load"),
    (90.0, None, "Burst/Unstable"),
]


def test_behavior_labels(spark):
    rows = [(m, v) for m, v, _ in FINAL]
    got = values(spark, rules.behavior_final(F.col("m"), F.col("v")), rows, "m double, v double")
    assert got == [x for *_, x in FINAL]
    v2 = values(spark, rules.behavior_v2(F.col("m"), F.col("v")), rows, "m double, v double")
    assert v2 == [x.replace("Extreme Load", "Burst/Unstable") for *_, x in FINAL]


def test_outlier_types_in_order(spark):
    rows = [(500.0, 90.0), (500.0, 5.0), (10.0, -15.0), (10.0, 5.0), (50.0, -80.0)]
    kind = rules.outlier_final(F.col("p"), F.col("d"), F.lit(400.0), F.lit(50.0))
    assert values(spark, kind, rows, "p double, d double") == [
        "Spike Event", "Sustained High-Load Anomaly", "Drop Event", "Erratic Fluctuation", "Spike Event",
    ]
    old = rules.outlier_v2(F.col("p"), F.col("d"), F.lit(400.0), F.lit(50.0))
    assert values(spark, old, rows[2:3], "p double, d double") == ["Erratic Fluctuation"]


@pytest.mark.parametrize(
    "shares,v2,final",
    [
        ({"Spike Event": 5.1}, "Unstable / Spiky", "Unstable / Spiky"),
        ({"Spike Event": 5.0, "Erratic Fluctuation": 5.0}, "Stable", "Stable"),
        ({"Erratic Fluctuation": 10.1}, "Unstable / Spiky", "Unstable / Spiky"),
        ({"Drop Event": 60.0}, "Stable", "Stable"),
        ({"High Load": 40.1}, "High-Load Consistent", "High-Load Consistent"),
        ({"Extreme Load": 10.1}, "Stable", "High-Load Consistent"),
    ],
)
def test_device_classes(spark, shares, v2, final):
    cols = [F.lit(float(shares.get(x, 0.0))).alias(share_column(x)) for x in ALL_LABELS]
    profile = spark.range(1).select(*cols)
    assert behavior.gpu_class_v2(profile).first().gpu_classification == v2
    assert behavior.gpu_class_final(profile).first().gpu_classification == final


def test_text_rules(spark):
    names = [("A100 or H100",), ("NVIDIA H100",), ("V100",), (None,)]
    assert values(spark, rules.gpu_type_of(F.col("n")), names, "n string") == ["A100", "H100", "Other", "Other"]
    labels = [("Low usage / idle cluster",), ("Medium usage cluster",), ("High spike cluster",), ("Cluster Rank 1",)]
    assert values(spark, rules.std_label_of(F.col("x")), labels, "x string") == [
        "Idle / Low usage cluster", "Moderate usage cluster", "High spike cluster", "Cluster Rank 1",
    ]
    hours = [(h,) for h in (0, 5, 6, 17, 18, 21, 22)]
    part = values(spark, daypart_of(F.col("h")), hours, "h int")
    assert part == ["Night/Early Morning"] * 2 + ["Daytime"] * 2 + ["Evening"] * 2 + ["Night/Early Morning"]
    assert values(spark, time_band_of(F.col("h")), hours[:3], "h int")[2] == "Morning (6-12)"


def test_timestamps(spark):
    bad = ["2024/04/20 10:00:00.5", " 2024/04/20 10:00:00.123456 ", "2024/04/20 10:00:00", "bad", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, timestamp string")
    got = [r.timestamp for r in clean.parse_ts_strict(df).orderBy("i").collect()]
    assert [x is None for x in got] == [False, False, True, True, True]
    assert got[0].microsecond == 500_000
    lenient = clean.parse_ts_lenient(df.where("i < 3")).where("timestamp IS NULL").count()
    assert lenient == 0
    with pytest.raises(Exception, match="bad timestamp"):
        clean.parse_ts_lenient(df).collect()
    assert clean.parse_ts_lenient(df, fail_on_bad=False).where("timestamp IS NULL").count() == 2


def test_missing_text_stays_missing_unless_asked(spark):
    df = spark.createDataFrame([(" a ",), (None,)], "hostname string")
    assert {r.hostname for r in clean.trim_strings(df).collect()} == {"a", None}
    assert {r.hostname for r in clean.trim_strings(df, null_as="nan").collect()} == {"a", "nan"}


def test_nan_power_is_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, 5.0), (1, float("nan")), (None, 2.0)], "t int, power_watts double")
    df = df.withColumnRenamed("t", "timestamp")
    assert clean.drop_invalid(df).count() == 1
    assert clean.data_quality(df).first().asDict() == {
        "rows_loaded": 3, "bad_timestamp": 1, "bad_power": 1, "rows_kept": 1,
    }


def test_ties_and_one_row_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("b", 9), ("b", 2)], "k string, h int")
    assert {r.k: r.modal_h for r in patterns.modal_value(df, ["k"], "h").collect()} == {"a": 1, "b": 9}
    power = spark.createDataFrame([(0, 5.0), (1, 5.0), (1, 15.0), (2, 1.0), (2, 9.0)], "hour int, power_watts double")
    kinds = {r.hour: r.kind for r in workload.bursty_hours(power).collect()}
    assert 0 not in kinds and kinds == {1: "balanced", 2: "bursty"}
    metrics = spark.createDataFrame(
        [("subset_1", 2.0, 5), ("subset_2", 2.0, 5), ("subset_3", 1.0, 0)], "subset string, variance double, spikes long"
    )
    assert stats.subset_compare(metrics).first().asDict() == {
        "highest_variance": "subset_1", "most_spikes": "subset_1", "most_stable": "subset_3",
    }


def test_value_on_a_quartile(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "power_watts double")
    got = {r.power_watts: r.state for r in workload.workload_state(df).collect()}
    assert got == {1.0: "Idle", 2.0: "Idle", 3.0: "Moderate", 4.0: "Moderate", 5.0: "Active"}


def test_no_outliers_gives_an_empty_table(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0)], "cluster int, power_watts double, power_delta double")
    assert behavior.outlier_type_counts(behavior.outlier_type_final(df)).count() == 0


def test_class_counts_examples(spark):
    rows = [(f"g{i}", "Unstable / Spiky") for i in range(7)] + [("s", "Stable")]
    profile = settle(spark.createDataFrame(rows, "gpu_id string, gpu_classification string"))
    got = {r.gpu_classification: (r.n, r.examples) for r in behavior.class_counts(profile).collect()}
    assert got == {"Unstable / Spiky": (7, "g0,g1,g2,g3,g4"), "Stable": (1, None)}
