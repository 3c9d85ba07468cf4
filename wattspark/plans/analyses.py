"""End-to-end analyses, from readings to result tables."""

from pyspark.sql import DataFrame

from wattspark.functions.timefeat import calendar_features, day_number, day_range_subset, time_features
from wattspark.operators.behavior import (
    gpu_class_final,
    gpu_profile,
    label_behavior,
    outlier_type_counts,
    peak_transition,
)
from wattspark.operators.common import settle
from wattspark.operators.density import dbscan_grid, dbscan_scalable
from wattspark.operators.downsample import gpu_downsample, node_downsample
from wattspark.operators.kmeans import OUTLIER_FEATURES, kmeans_by_group, outlier_kmeans_global
from wattspark.operators.outliers import all_outliers, subset_outliers
from wattspark.operators.peaks import telemetry_features
from wattspark.operators.scaling import scaled_names, standardize
from wattspark.operators.stats import union_stats

FEATURES = ["power_watts", "rolling_mean_power", "power_delta"]

# Candidate radii of the two grid searches.
GRID_V2 = [0.161, 0.2, 0.25, 0.3]
GRID_FINAL = [0.15, 0.161, 0.18, 0.2, 0.25]


def abnormal_power(readings: DataFrame) -> DataFrame:
    """When did each device and each node draw abnormal power?"""
    return all_outliers(node_downsample(readings), gpu_downsample(readings))


def power_statistics(readings: DataFrame) -> DataFrame:
    return union_stats(node_downsample(readings), gpu_downsample(readings))


def reduced_with_time(readings: DataFrame) -> DataFrame:
    """The 5-minute device series with hour, elapsed day and calendar columns."""
    return calendar_features(day_number(time_features(gpu_downsample(readings))))


def outliers_of_subsets(readings: DataFrame) -> DataFrame:
    """Outliers of every day-range subset, with the time columns used for clustering."""
    return settle(subset_outliers(day_range_subset(reduced_with_time(readings))))


def clustered_outliers(readings: DataFrame) -> DataFrame:
    """Outliers of every subset clustered globally, per node and per bus id."""
    found = outlier_kmeans_global(outliers_of_subsets(readings))
    per_node = kmeans_by_group(
        settle(found), ["subset", "hostname"], OUTLIER_FEATURES, name="node_cluster"
    )
    return kmeans_by_group(
        settle(per_node), ["subset", "pci_bus_id"], OUTLIER_FEATURES, name="gpu_cluster"
    )


def scaled_telemetry(readings: DataFrame) -> DataFrame:
    """Feature rows with the scaled features, stored once for the clustering passes."""
    scaled, _ = standardize(settle(telemetry_features(readings)), FEATURES)
    return settle(scaled)


def density_clusters(readings: DataFrame) -> DataFrame:
    """Readings with the density cluster from the self-tuned radius."""
    return dbscan_scalable(scaled_telemetry(readings), scaled_names(FEATURES))[0]


def deep_analysis(readings: DataFrame, candidates: list[float] | None = None) -> dict[str, DataFrame]:
    """Grid search, labels for all rows, and the tables that give them meaning."""
    rows, scores = dbscan_grid(
        scaled_telemetry(readings), scaled_names(FEATURES), candidates or GRID_FINAL
    )
    labelled = settle(label_behavior(settle(rows)))
    return {
        "scores": scores,
        "clustered": labelled,
        "outlier_types": outlier_type_counts(labelled),
        "gpu_profile": gpu_class_final(gpu_profile(labelled)),
        "transition": peak_transition(labelled),
    }
