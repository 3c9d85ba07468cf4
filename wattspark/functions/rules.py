"""Threshold rules as Column expressions (evaluated inside whole-stage codegen).

A NULL input makes a comparison NULL, so such a row falls through to the last branch.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def gpu_type_of(name: Column) -> Column:
    return F.when(name.contains("A100"), "A100").when(name.contains("H100"), "H100").otherwise("Other")


def std_label_of(label: Column) -> Column:
    text = F.lower(label)
    return (
        F.when(text.contains("idle") | text.contains("low"), "Idle / Low usage cluster")
        .when(text.contains("medium") | text.contains("moderate"), "Moderate usage cluster")
        .when(text.contains("high") | text.contains("spike"), "High spike cluster")
        .otherwise(label)
    )


def _load_levels(mean: Column, var: Column) -> Column:
    return (
        F.when((mean < 100) & (var < 500), "Idle/Low Load")
        .when((mean < 150) & (var < 1000), "Moderate Load")
        .when((mean >= 150) & (var < 2000), "High Load")
    )


def behavior_v2(mean: Column, var: Column) -> Column:
    return _load_levels(mean, var).otherwise("Burst/Unstable")


def behavior_final(mean: Column, var: Column) -> Column:
    return _load_levels(mean, var).when(mean >= 300, "Extreme Load").otherwise("Burst/Unstable")


def _outlier_core(power: Column, delta: Column, p95_power: Column, p95_delta: Column) -> Column:
    return F.when(F.abs(delta) > p95_delta, "Spike Event").when(
        power > p95_power, "Sustained High-Load Anomaly"
    )


def outlier_v2(power: Column, delta: Column, p95_power: Column, p95_delta: Column) -> Column:
    return _outlier_core(power, delta, p95_power, p95_delta).otherwise("Erratic Fluctuation")


def outlier_final(
    power: Column,
    delta: Column,
    p95_power: Column,
    p95_delta: Column,
    low: float = 20,
    jump: float = 10,
) -> Column:
    return (
        _outlier_core(power, delta, p95_power, p95_delta)
        .when((power < low) & (F.abs(delta) > jump), "Drop Event")
        .otherwise("Erratic Fluctuation")
    )


def _outlier_share() -> Column:
    # A Drop Event is not part of a device's outlier share.
    return (
        F.col("pct_time_spike_event")
        + F.col("`pct_time_sustained_high-load_anomaly`")
        + F.col("pct_time_erratic_fluctuation")
        + F.col("pct_time_outlier")
    )


def gpu_class_rule(with_extreme: bool) -> Column:
    high = F.col("pct_time_high_load") > 40
    if with_extreme:
        high = high | (F.col("pct_time_extreme_load") > 10)
    return (
        F.when((_outlier_share() > 10) | (F.col("pct_time_spike_event") > 5), "Unstable / Spiky")
        .when(high, "High-Load Consistent")
        .otherwise("Stable")
    )


def usage_pattern(cv: Column, cut: float = 0.5) -> Column:
    return F.when(cv > cut, "BURSTY").otherwise("BALANCED")
