"""Table layouts and closed label lists."""

from pyspark.sql import types as T

POWER = "power_watts"
GPU_KEYS = ["hostname", "pci_bus_id"]
NODE_TOTAL = "NODE_TOTAL"

# One reading per device as it arrives: everything text until cleaned.
RAW = T.StructType(
    [
        T.StructField("hostname", T.StringType()),
        T.StructField("gpu_name", T.StringType()),
        T.StructField("pci_bus_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("power_watts", T.DoubleType()),
    ]
)

# The behaviour labels that the rules can give.
BEHAVIOR_LABELS = [
    "Idle/Low Load",
    "Moderate Load",
    "High Load",
    "Extreme Load",
    "Burst/Unstable",
]
OUTLIER_LABELS = [
    "Spike Event",
    "Sustained High-Load Anomaly",
    "Drop Event",
    "Erratic Fluctuation",
]
OUTLIER = "Outlier"
ALL_LABELS = BEHAVIOR_LABELS + OUTLIER_LABELS + [OUTLIER]

# K-Means cluster names by rank of mean power when there are three clusters.
RANK_LABELS = ["Low usage / idle cluster", "Medium usage cluster", "High spike cluster"]

WORKLOAD_STATES = ["Idle", "Moderate", "Active"]


def share_column(label: str) -> str:
    """Column name that holds the share of time spent in `label`."""
    return "pct_time_" + label.lower().replace(" ", "_").replace("/", "_")
