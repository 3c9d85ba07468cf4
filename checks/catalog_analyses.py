"""End-to-end analyses, on the labels that the clustering itself gives."""

from pyspark.sql import DataFrame

from checks import base, catalog_basic, catalog_cluster  # noqa: F401  (their pieces are used here)
from checks.base import again, stored, tel
from wattspark.operators import behavior, patterns
from wattspark.operators.common import settle
from wattspark.plans import analyses

# The stand-in cluster columns give way to the density labels of the best radius, and to K-Means labels.
DENSITY = {"clu": ("SELECT t.*, l.cluster FROM telf t JOIN fbest_labels l USING (row_id)", "telf fbest_labels")}
KMEANS = {"sublab": ("SELECT *, cluster_label AS global_cluster_label FROM kg", "kg")}


def deep(s, f) -> dict[str, DataFrame]:
    key = (s.sparkContext.applicationId, f, "deep_analysis")
    if key not in base._memo:
        base._memo[key] = analyses.deep_analysis(tel(s, f))
    return base._memo[key]


@stored
def subset_labels(s, f):
    return analyses.clustered_outliers(tel(s, f))


again("deep_outlier_types", "outlier_type_counts", lambda s, f: deep(s, f)["outlier_types"], DENSITY)
again("deep_gpu_profile", "gpu_class_final", lambda s, f: deep(s, f)["gpu_profile"].select("gpu_id", "gpu_classification"), DENSITY)
again("deep_transition", "peak_transition", lambda s, f: deep(s, f)["transition"], DENSITY)
again("deep_cluster_stats", "cluster_stats", lambda s, f: behavior.cluster_stats(deep(s, f)["clustered"]), DENSITY)
again("deep_top_outlier_gpus", "top_outlier_gpus", lambda s, f: behavior.top_outlier_gpus(deep(s, f)["clustered"]), DENSITY)
again("deep_outliers_per_hour", "outliers_per_hour", lambda s, f: behavior.outliers_per_hour(deep(s, f)["clustered"]), DENSITY)
again("subset_cluster_summary", "outlier_cluster_summary", lambda s, f: patterns.outlier_cluster_summary(subset_labels(s, f), ["subset"]), KMEANS)
again("subset_cluster_profile", "outlier_cluster_profile", lambda s, f: patterns.outlier_cluster_profile(subset_labels(s, f), ["subset"]), KMEANS)
again("subset_timing", "timing_pattern", lambda s, f: patterns.timing_pattern(subset_labels(s, f), ["subset"]), KMEANS)
again("power_statistics", "union_stats", lambda s, f: settle(analyses.power_statistics(tel(s, f))), {})
