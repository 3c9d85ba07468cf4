"""Inputs shared by the registered queries, their SQL twins, and the comparable output form."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.functions.timefeat import day_range_subset
from wattspark.operators.behavior import label_behavior
from wattspark.operators.common import settle
from wattspark.operators.downsample import gpu_downsample, node_downsample
from wattspark.operators.peaks import telemetry_features
from wattspark.plans import analyses
from wattspark.sources.readers import read_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RECIPES: dict[str, dict[str, str]] = {}
_memo: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drop stored intermediate tables, so that the next query does all of its own work."""
    _memo.clear()


def stored(build: Query) -> Query:
    """Compute an input table once per session and data folder."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _memo:
            _memo[key] = settle(build(spark, sf))
        return _memo[key]

    return get


def canonical(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles to four decimals, times and dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.floor(c.cast("double") * 10000 + 0.5000001) / 10000
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def add(name: str, build: Query, sql: str | None = None, d="", i="", t="", dt="", with_: str = "") -> None:
    """Register a query; d/i/t/dt name its double, integer, timestamp and date columns."""
    QUERIES[name] = lambda spark, sf: canonical(build(spark, sf))
    if sql is None:
        return
    RECIPES[name] = {"sql": sql, "d": d, "i": i, "t": t, "dt": dt, "with_": with_}
    parts = [f'floor("{c}" * 10000 + 0.5000001) / 10000 AS "{c}"' for c in d.split()]
    parts += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i.split()]
    parts += [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\"" for c in t.split()]
    parts += [f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in dt.split()]
    star = f"* REPLACE ({', '.join(parts)})" if parts else "*"
    SQL[name] = f"WITH RECURSIVE {ctes(with_, sql)}\nout AS ({sql})\nSELECT {star} FROM out"


def again(name: str, source: str, build: Query, pieces: dict[str, tuple[str, str]]) -> None:
    """Register `build` under the SQL of query `source`, with some of its pieces replaced."""
    kept = {p: (PIECES[p], BUILDS_ON.get(p, "")) for p in pieces}
    for p, (sql, needs) in pieces.items():
        piece(p, sql, needs)
    add(name, build, **RECIPES[source])
    for p, (sql, needs) in kept.items():
        piece(p, sql, needs)


# ---- SQL pieces; each names the pieces it builds on -------------------------------------------

PIECES: dict[str, str] = {
    "tel": """SELECT event_id AS row_id,
        'node' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS hostname,
        CASE WHEN user_id % 10 < 4 THEN 'NVIDIA A100-SXM4-40GB' ELSE 'NVIDIA H100 80GB HBM3' END AS gpu_name,
        event_type AS pci_bus_id, ts AS timestamp, value * 2.0::DOUBLE AS power_watts FROM events""",
    "timed": """SELECT *, hostname || '_' || pci_bus_id AS gpu_id, hour(timestamp) AS hour, day(timestamp) AS day,
        isodow(timestamp) - 1 AS day_of_week,
        CASE WHEN gpu_name LIKE '%A100%' THEN 'A100' WHEN gpu_name LIKE '%H100%' THEN 'H100' ELSE 'Other' END AS gpu_type
        FROM tel""",
    "feat": """SELECT *, avg(power_watts) OVER (PARTITION BY gpu_id ORDER BY timestamp, row_id
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mean_power,
        coalesce(power_watts - lag(power_watts) OVER (PARTITION BY gpu_id ORDER BY timestamp, row_id), 0) AS power_delta
        FROM timed""",
    "hours": "SELECT hour, avg(power_watts) AS avg_power FROM timed GROUP BY hour",
    "peak": "SELECT * FROM hours WHERE avg_power >= (SELECT quantile_cont(avg_power, 0.7::DOUBLE) FROM hours)",
    "telf": "SELECT *, CAST(hour IN (SELECT hour FROM peak) AS INTEGER) AS is_peak FROM feat",
    # A rule stands in for the clustering, so that the rules after it are checked on their own.
    "clu": """SELECT *, CASE WHEN abs(power_delta) > 200 OR power_watts > 400 THEN -1
        WHEN power_watts < 150 THEN CAST(floor(power_watts / 50) AS INTEGER)
        ELSE 3 + CAST(floor(rolling_mean_power / 100) AS INTEGER) END AS cluster FROM telf""",
    "stats": """SELECT cluster, avg(power_watts) AS avg_power, var_samp(power_watts) AS power_var,
        avg(power_delta) AS avg_delta, count(*) AS point_count FROM clu WHERE cluster <> -1 GROUP BY cluster""",
    "slab": """SELECT *, CASE WHEN avg_power < 100 AND power_var < 500 THEN 'Idle/Low Load'
        WHEN avg_power < 150 AND power_var < 1000 THEN 'Moderate Load'
        WHEN avg_power >= 150 AND power_var < 2000 THEN 'High Load'
        WHEN avg_power >= 300 THEN 'Extreme Load' ELSE 'Burst/Unstable' END AS behavior_label FROM stats""",
    "p95": """SELECT quantile_cont(abs(power_delta), 0.95::DOUBLE) AS pd, quantile_cont(power_watts, 0.95::DOUBLE) AS pp
        FROM clu""",
    "lab": """SELECT c.*, CASE WHEN c.cluster = -1 THEN CASE WHEN abs(power_delta) > pd THEN 'Spike Event'
        WHEN power_watts > pp THEN 'Sustained High-Load Anomaly'
        WHEN power_watts < 20 AND abs(power_delta) > 10 THEN 'Drop Event'
        ELSE 'Erratic Fluctuation' END END AS outlier_type,
        coalesce(outlier_type, s.behavior_label) AS behavior_label
        FROM clu c CROSS JOIN p95 LEFT JOIN slab s USING (cluster)""",
    "red": """SELECT hostname, pci_bus_id, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp,
        avg(power_watts) AS power_watts FROM tel GROUP BY ALL""",
    "node": """SELECT hostname, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp,
        sum(power_watts) AS power_watts FROM tel GROUP BY ALL""",
    "redt": """SELECT *, hour(timestamp) AS hour, CAST(timestamp AS DATE) AS date,
        CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM red)) / 86400000000) AS BIGINT) + 1 AS day_num
        FROM red""",
    "subs": "SELECT *, 'subset_' || CAST((day_num - 1) // 3 + 1 AS VARCHAR) AS subset FROM redt",
    "subq": """SELECT subset, quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.75::DOUBLE) AS q3
        FROM subs GROUP BY subset""",
    "subout": """SELECT s.* FROM subs s JOIN subq q USING (subset)
        WHERE power_watts < q1 - 1.5 * (q3 - q1) OR power_watts > q3 + 1.5 * (q3 - q1)""",
    # Rank labels by power terciles stand in for K-Means in the summaries of clustered outliers.
    "subcut": """SELECT subset, quantile_cont(power_watts, 0.25::DOUBLE) AS a, quantile_cont(power_watts, 0.75::DOUBLE) AS b
        FROM subout GROUP BY subset""",
    "sublab": """SELECT o.*, CASE WHEN power_watts <= a THEN 'Low usage / idle cluster'
        WHEN power_watts <= b THEN 'Medium usage cluster' ELSE 'High spike cluster' END AS global_cluster_label
        FROM subout o JOIN subcut USING (subset)""",
    "redc": """SELECT *, CAST(floor(power_watts / 60) AS BIGINT) % 3 AS cluster FROM redt""",
    "spk": "SELECT * FROM redc WHERE power_watts >= (SELECT quantile_cont(power_watts, 0.75::DOUBLE) FROM redc)",
    "cuts": """SELECT quantile_cont(power_watts, 0.25::DOUBLE) AS lo, quantile_cont(power_watts, 0.75::DOUBLE) AS hi FROM redt""",
    "state": """SELECT *, CASE WHEN power_watts <= lo THEN 'Idle' WHEN power_watts <= hi THEN 'Moderate' ELSE 'Active' END AS state
        FROM redt CROSS JOIN cuts""",
}
BUILDS_ON = {
    "timed": "tel", "feat": "timed", "hours": "timed", "peak": "hours", "telf": "feat peak", "clu": "telf",
    "stats": "clu", "slab": "stats", "p95": "clu", "lab": "clu p95 slab", "red": "tel", "node": "tel",
    "redt": "red", "subs": "redt", "subq": "subs", "subout": "subs subq", "subcut": "subout",
    "sublab": "subout subcut", "redc": "redt", "spk": "redc", "cuts": "redt", "state": "redt cuts",
}


def piece(name: str, sql: str, needs: str) -> None:
    PIECES[name] = sql
    BUILDS_ON[name] = needs


def ctes(names: str, body: str = "") -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for m in BUILDS_ON.get(n, "").split():
            visit(m)
        done.append(n)

    for n in names.split():
        visit(n)
    # A piece that starts with USING KEY is a recursion over (run, id, comp).
    return "".join(
        f"{n}(run, id, comp) {PIECES[n]},\n"
        if PIECES[n].startswith("USING KEY")
        else f"{n} AS MATERIALIZED ({PIECES[n]}),\n"
        for n in done
    )


# ---- the same tables in Spark ------------------------------------------------------------------


def tel(spark: SparkSession, sf: str) -> DataFrame:
    return read_events(spark, sf)


@stored
def telf(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry_features(tel(spark, sf))


@stored
def clu(spark: SparkSession, sf: str) -> DataFrame:
    noise = (F.abs("power_delta") > 200) | (F.col("power_watts") > 400)
    return telf(spark, sf).withColumn(
        "cluster",
        F.when(noise, -1)
        .when(F.col("power_watts") < 150, F.floor(F.col("power_watts") / 50).cast("int"))
        .otherwise(3 + F.floor(F.col("rolling_mean_power") / 100).cast("int")),
    )


@stored
def lab(spark: SparkSession, sf: str) -> DataFrame:
    return label_behavior(clu(spark, sf))


@stored
def red(spark: SparkSession, sf: str) -> DataFrame:
    return gpu_downsample(tel(spark, sf))


@stored
def node(spark: SparkSession, sf: str) -> DataFrame:
    return node_downsample(tel(spark, sf))


@stored
def redt(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.reduced_with_time(tel(spark, sf))


def subs(spark: SparkSession, sf: str) -> DataFrame:
    return day_range_subset(redt(spark, sf))


@stored
def subout(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.outliers_of_subsets(tel(spark, sf))


@stored
def sublab(spark: SparkSession, sf: str) -> DataFrame:
    from wattspark.operators.quantiles import quantiles

    found = subout(spark, sf)
    cuts = settle(quantiles(found, ["subset"], "power_watts", [0.25, 0.75], ["a", "b"]).drop("n"))
    label = (
        F.when(F.col("power_watts") <= F.col("a"), "Low usage / idle cluster")
        .when(F.col("power_watts") <= F.col("b"), "Medium usage cluster")
        .otherwise("High spike cluster")
    )
    return found.join(cuts, "subset").withColumn("global_cluster_label", label).drop("a", "b")


def redc(spark: SparkSession, sf: str) -> DataFrame:
    return redt(spark, sf).withColumn(
        "cluster", (F.floor(F.col("power_watts") / 60) % 3).cast("int")
    )


@stored
def spk(spark: SparkSession, sf: str) -> DataFrame:
    from wattspark.operators.patterns import spike_rows

    return spike_rows(redc(spark, sf))


@stored
def states(spark: SparkSession, sf: str) -> DataFrame:
    from wattspark.operators.workload import workload_state

    return workload_state(redt(spark, sf))
