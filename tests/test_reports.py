import datetime

import pytest

from wattspark.operators.features import label_encode
from wattspark.plans import reports

SHAPE = "hostname string, gpu_id string, gpu_type string, hour int, date date, cluster int, behavior_label string, is_peak int, outlier_type string, power_watts double"


def labelled(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        ("a", "a_0", "A100", 0, day, 0, "High Load", 0, None, 100.0),
        ("a", "a_0", "A100", 0, day, 0, "High Load", 1, None, 200.0),
        ("b", "b_0", "H100", 7, day, -1, "Spike Event", 1, "Spike Event", 900.0),
        (None, "b_0", None, 7, day, 1, None, None, None, 50.0),
    ]
    return spark.createDataFrame(rows, SHAPE)


def test_facts_keep_null_groups_apart(spark):
    facts = {(r.fact, r.hostname, r.cluster): (r.n, r.noise, r["mean"]) for r in reports.report_facts(labelled(spark)).collect() if r.fact in ("total", "host", "cluster")}
    assert facts == {
        ("total", None, None): (4, 1, 312.5),
        ("host", "a", None): (2, 0, 150.0),
        ("host", "b", None): (1, 1, 900.0),
        ("host", None, None): (1, 0, 50.0),
        ("cluster", None, 0): (2, 0, 150.0),
        ("cluster", None, -1): (1, 1, 900.0),
        ("cluster", None, 1): (1, 0, 50.0),
    }


def test_final_report_of_a_small_table(spark):
    facts = reports.report_facts(labelled(spark))
    rows = {(r.section, r.key): r.value for r in reports.final_report(facts, 0.2).collect()}
    assert rows["clusters", "n_clusters"] == "2" and rows["noise_pct", "outlier_pct"] == "25.0000"
    assert rows["inliers_pct", "Peak"] == "50.0000" and rows["outlier_hours", "7"] == "1"
    assert rows["balance_from", "b"] == "900.0000"
    assert '"clustering_radius":0.2' in reports.final_report_json(facts, 0.2).first().report


@pytest.mark.parametrize("report", [lambda f: reports.final_report(f, 0.1), lambda f: reports.deep_report(f, 0.1), lambda f: reports.final_report_json(f, 0.1)])
def test_empty_table(spark, report):
    report(reports.report_facts(labelled(spark).limit(0))).collect()


def test_patterns_of_empty_and_tiny_tables(spark):
    assert reports.pattern_report(labelled(spark).limit(0)).where("section = 'day_dominance'").count() == 0
    rows = {(r.section, r.key): r.value for r in reports.pattern_report(labelled(spark)).collect()}
    assert rows["spike_hours", "7"] == "1" and rows["day_dominance", "2024-01-01"].startswith("0 ")


@pytest.mark.parametrize("within", [[], ["g"], ["g", "h"]])
def test_codes_over_ranges(spark, within):
    rows = [(k % 3 or None, k % 2, f"v{k * 7 % 50:02d}" if k % 11 else None) for k in range(400)]
    got = label_encode(spark.createDataFrame(rows, "g int, h int, v string").repartition(6), "v", within).where("v IS NOT NULL AND g IS NOT NULL").collect()
    groups = {}
    for g, h, v in rows:
        groups.setdefault(tuple({"g": g, "h": h}[c] for c in within), set()).add(v)
    order = {k: sorted(vs, key=lambda v: (v is not None, v or "")) for k, vs in groups.items()}
    assert all(r.encoded_v == order[tuple(r[c] for c in within)].index(r.v) for r in got)
