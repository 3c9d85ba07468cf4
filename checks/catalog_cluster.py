"""Scaling, K-Means, density clustering, projection and streaming."""

from pyspark.sql import functions as F

from checks.base import add, piece, red, redt, stored, subout, tel, telf, redc
from wattspark.operators import density, kmeans, outliers, patterns, projection, scaling
from wattspark.operators.common import scratch_path, settle
from wattspark.operators.features import label_encode
from wattspark.plans import analyses, reports
from wattspark.schema import GPU_KEYS
from wattspark.sources.readers import reading_key
from wattspark.streaming import jobs

FEATS = analyses.FEATURES
Z = scaling.scaled_names(FEATS)
EX = ["power_watts", "hour", "day_num"]
EXZ = scaling.scaled_names(EX)
# Lloyd rounds written out in SQL. Rounds after the fixed point change nothing, so any number at or
# above the rounds to converge gives the same labels; the Spark side has no round limit.
ROUNDS = 45
RED = [*GPU_KEYS, "timestamp", "power_watts"]
RCOLS = "hostname, pci_bus_id, timestamp, power_watts"


# ---- inputs ------------------------------------------------------------------------------------


@stored
def pts(s, f):
    return scaling.standardize(telf(s, f), FEATS)[0]


@stored
def exz(s, f):
    """Reduced rows with a key, the stand-in cluster and scaled features."""
    return scaling.standardize(reading_key(redc(s, f)), EX)[0]


def scaled_sql(table: str, feats: list[str], keys: str = "") -> str:
    """SELECT *, <f>_z ... over the whole table or per group."""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    cols = ", ".join(
        f"CASE WHEN stddev_pop({c}) {over} > 0 THEN ({c} - avg({c}) {over}) / stddev_pop({c}) {over} ELSE 0 END AS {c}_z"
        for c in feats
    )
    return f"SELECT *, {cols} FROM {table}"


piece("pts", scaled_sql("telf", FEATS), "telf")
piece("exz", scaled_sql("(SELECT *, hostname || '|' || pci_bus_id || '|' || strftime(timestamp, '%Y%m%d%H%M%S') AS row_id FROM redc)", EX), "redc")
ZD = " ".join(Z)

# 122-123 scaling
add("standardize", lambda s, f: scaling.standardize(telf(s, f), FEATS)[0].select("row_id", *Z), f"SELECT row_id, {', '.join(Z)} FROM pts", d=ZD, i="row_id", with_="pts")
add(
    "standardize_apply",
    lambda s, f: scaling.standardize_apply(telf(s, f).where("is_peak = 1"), scaling.fit_scaler(telf(s, f), FEATS), FEATS).select("row_id", *Z),
    f"SELECT row_id, {', '.join(Z)} FROM pts WHERE is_peak = 1", d=ZD, i="row_id", with_="pts",
)


# ---- K-Means -----------------------------------------------------------------------------------


def km_pieces(tag: str, source: str, keys: list[str], feats: list[str], rounds: int, needs: str, k: int = 3) -> str:
    """Lloyd rounds written out; gives the piece `<tag>` = source rows with `cluster` by mean power."""
    ks = ", ".join(keys)
    by = f"GROUP BY {ks}" if keys else ""
    on = f"JOIN {{}} USING ({ks})" if keys else "CROSS JOIN {}"
    cuts = ", ".join(f"quantile_cont(power_watts, {i / k!r}::DOUBLE) AS _q{i}" for i in range(1, k))
    lead = f"{ks}, " if keys else ""
    piece(f"{tag}q", f"SELECT {lead}{cuts} FROM {source} {by}", needs)
    case = " ".join(f"WHEN power_watts <= _q{i} THEN {i - 1}" for i in range(1, k))
    piece(f"{tag}a0", f"SELECT *, CASE {case} ELSE {k - 1} END AS _c FROM {source} {on.format(tag + 'q')}", f"{tag}q")
    prev = f"{tag}a0"
    cents = [(j, i, x) for j in range(k) for i, x in enumerate(feats)]
    for r in range(rounds + 1):
        cols = ", ".join(
            f"avg(CASE WHEN _c = {j} THEN {x} END) AS _n{j}_{i}" if r == 0
            else f"coalesce(avg(CASE WHEN _c = {j} THEN {x} END), any_value(_n{j}_{i})) AS _n{j}_{i}"
            for j, i, x in cents
        )
        piece(f"{tag}c{r}", f"SELECT {lead}{cols} FROM {prev} {by}", prev)
        dist = ", ".join(
            "coalesce(" + " + ".join(f"({x} - _n{j}_{i}) * ({x} - _n{j}_{i})" for i, x in enumerate(feats)) + f", 'infinity'::DOUBLE) AS _d{j}"
            for j in range(k)
        )
        least = "least(" + ", ".join(f"_d{j}" for j in range(k)) + ")"
        pick = " ".join(f"WHEN _d{j} <= {least} THEN {j}" for j in range(k))
        piece(
            f"{tag}a{r + 1}",
            f"SELECT *, CASE {pick} END AS _c FROM (SELECT *, {dist} FROM {source} {on.format(f'{tag}c{r}')})",
            f"{tag}c{r} {needs}",
        )
        prev = f"{tag}a{r + 1}"
    part = f"PARTITION BY {ks}" if keys else ""
    same = " AND ".join(f"a.{x} = m.{x}" for x in ["_c", *keys])
    piece(
        tag,
        f"""SELECT a.* EXCLUDE (cluster), m.cluster FROM (SELECT *, 0 AS cluster FROM {prev}) a JOIN (SELECT {lead}_c,
        row_number() OVER ({part} ORDER BY avg(power_watts), _c) - 1 AS cluster FROM {prev} GROUP BY {lead}_c) m ON {same}""",
        prev,
    )
    return tag


NAMES = "['Low usage / idle cluster', 'Medium usage cluster', 'High spike cluster']"


def group_pieces(tag: str, source: str, keys: list[str], feats: list[str], rounds: int, needs: str) -> None:
    """Per-group scaling, K-Means and rank labels; groups below three rows get -1 / 'None'."""
    ks = ", ".join(keys)
    piece(f"{tag}n", f"SELECT *, count(*) OVER (PARTITION BY {ks}) AS _size FROM {source}", needs)
    piece(f"{tag}z", scaled_sql(f"(SELECT * FROM {tag}n WHERE _size >= 3)", feats, ks), f"{tag}n")
    km_pieces(f"{tag}k", f"{tag}z", keys, scaling.scaled_names(feats), rounds, f"{tag}z")
    piece(
        tag,
        f"""SELECT s.* EXCLUDE (_size), coalesce(k.cluster, -1) AS cluster, CASE WHEN k.cluster IS NULL THEN 'None'
        WHEN k.nk = 3 THEN {NAMES}[k.cluster + 1] ELSE 'Cluster Rank ' || (k.cluster + 1) END AS cluster_label
        FROM {tag}n s LEFT JOIN (SELECT *, max(cluster) OVER (PARTITION BY {ks}) + 1 AS nk FROM {tag}k) k
        ON s.subset = k.subset AND s.hostname = k.hostname AND s.pci_bus_id = k.pci_bus_id AND s.timestamp = k.timestamp""",
        f"{tag}n {tag}k",
    )


km_pieces("km", "(SELECT * EXCLUDE (cluster) FROM exz)", [], EXZ, ROUNDS, "exz")
piece("code", "SELECT *, CAST(dense_rank() OVER (PARTITION BY subset ORDER BY pci_bus_id) - 1 AS DOUBLE) AS encoded_pci_bus_id FROM subout", "subout")
OF = kmeans.OUTLIER_FEATURES
group_pieces("kg", "code", ["subset"], OF, ROUNDS, "code")
group_pieces("kn", "code", ["subset", "hostname"], OF, ROUNDS, "code")
group_pieces("kb", "code", ["subset", "pci_bus_id"], OF, ROUNDS, "code")


@stored
def km(s, f):
    return kmeans.kmeans_det(exz(s, f).drop("cluster"), EXZ)


def kmeans_random(s, f):
    rows, cost = kmeans.kmeans(exz(s, f).drop("cluster"), EXZ)
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("power_watts").alias("mean_power"))
    return patterns.rank_clusters(sizes, [], "cluster", "mean_power").select("rank", "size", "mean_power", F.lit(cost).alias("inertia"))


def kmeans_facts(s, f):
    """What is known of random starts: all rows in k clusters, at no higher cost than the fixed start."""
    rows, cost = kmeans.kmeans(exz(s, f).drop("cluster"), EXZ)
    fixed = kmeans.inertia(kmeans.centroid_distance(km(s, f), EXZ)).first()["inertia"]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("n_clusters")).withColumn(
        "no_worse", F.lit(int(cost <= fixed * 1.0001))
    )


add("kmeans", kmeans_random)
add("kmeans_facts", kmeans_facts, "SELECT count(*) AS n_rows, 3 AS n_clusters, 1 AS no_worse FROM exz", i="n_rows n_clusters no_worse", with_="exz")
add(
    "kmeans_det", lambda s, f: kmeans.kmeans_det(exz(s, f).drop("cluster"), EXZ).select("row_id", "cluster"),
    "SELECT row_id, cluster FROM km", i="cluster", with_="km",
)


def by_group(s, f, keys, name):
    coded = settle(label_encode(subout(s, f), "pci_bus_id", ["subset"]))
    out = kmeans.kmeans_by_group(coded, ["subset", *keys], OF, name=name)
    return out.select("subset", *RED, name, f"{name}_label")


for key, tag, name, cols in (
    ("kmeans_by_group", "kn", "node_cluster", ["hostname"]),
    ("kmeans_by_group_bus", "kb", "gpu_cluster", ["pci_bus_id"]),
):
    add(
        key, lambda s, f, cols=cols, name=name: by_group(s, f, cols, name),
        f"SELECT subset, {RCOLS}, cluster AS {name}, cluster_label AS {name}_label FROM {tag}",
        d="power_watts", i=name, t="timestamp", with_=tag,
    )
add(
    "outlier_kmeans_global",
    lambda s, f: kmeans.outlier_kmeans_global(subout(s, f)).select("subset", *RED, "global_cluster", "global_cluster_label"),
    f"SELECT subset, {RCOLS}, cluster AS global_cluster, cluster_label AS global_cluster_label FROM kg",
    d="power_watts", i="global_cluster", t="timestamp", with_="kg",
)
add(
    "outlier_back_join",
    lambda s, f: analyses.clustered_outliers(tel(s, f)).select(
        "subset", *RED, "global_cluster", "node_cluster", "gpu_cluster", "node_cluster_label", "gpu_cluster_label"
    ),
    f"""SELECT g.subset, g.hostname, g.pci_bus_id, g.timestamp, g.power_watts, g.cluster AS global_cluster, n.cluster AS node_cluster,
    b.cluster AS gpu_cluster, n.cluster_label AS node_cluster_label, b.cluster_label AS gpu_cluster_label
    FROM kg g JOIN kn n USING (subset, hostname, pci_bus_id, timestamp) JOIN kb b USING (subset, hostname, pci_bus_id, timestamp)""",
    d="power_watts", i="global_cluster node_cluster gpu_cluster", t="timestamp", with_="kg kn kb",
)

# 45, 129-134: distances and quality, on the stand-in cluster (so that each is checked alone)
DIST = "SELECT e.*, sqrt(" + " + ".join(f"(e.{x} - m{i}) * (e.{x} - m{i})" for i, x in enumerate(EXZ)) + ") AS dist FROM {t} e JOIN (SELECT cluster, " + ", ".join(
    f"avg({x}) AS m{i}" for i, x in enumerate(EXZ)
) + " FROM {t} GROUP BY cluster) USING (cluster)"
piece("dist", DIST.format(t="exz"), "exz")
piece("kmdist", DIST.format(t="km"), "km")


def dist(s, f):
    return kmeans.centroid_distance(exz(s, f), EXZ)


RADIUS = """SELECT cluster, count(*) AS size, avg(dist) AS avg_dist, max(dist) AS max_dist, stddev_pop(dist) AS std_dist,
    avg(power_watts) AS "mean_power_W" FROM {t} GROUP BY cluster"""
RD = "avg_dist max_dist std_dist mean_power_W"
add("centroid_distance", lambda s, f: dist(s, f).select("row_id", "dist"), "SELECT row_id, dist FROM dist", d="dist", with_="dist")
add("inertia", lambda s, f: kmeans.inertia(dist(s, f)), "SELECT sum(dist * dist) AS inertia FROM dist", d="inertia", with_="dist")
add("cluster_radius", lambda s, f: kmeans.cluster_radius(dist(s, f)), RADIUS.format(t="dist"), d=RD, i="cluster size", with_="dist")
TIGHT = "SELECT *, CASE WHEN avg_dist < (SELECT median(avg_dist) FROM ({r})) THEN 'Tight' ELSE 'Spread' END AS tightness FROM ({r})"
add(
    "tightness", lambda s, f: kmeans.tightness(settle(kmeans.cluster_radius(dist(s, f)))),
    TIGHT.format(r=RADIUS.format(t="dist")), d=RD, i="cluster size", with_="dist",
)
D2 = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in EXZ)
SIL = """SELECT avg(CASE WHEN own_n = 1 THEN 0 WHEN greatest(x, y) > 0 THEN (y - x) / greatest(x, y) ELSE 0 END) AS silhouette FROM
    (SELECT id, max(n) FILTER (own) AS own_n, max(s / (n - 1)) FILTER (own AND n > 1) AS x, min(s / n) FILTER (NOT own) AS y FROM
      (SELECT a.row_id AS id, a.cluster = b.cluster AS own, b.cluster AS bc, sum({d}) AS s FROM {t} a CROSS JOIN {t} b GROUP BY ALL)
      JOIN (SELECT cluster AS bc, count(*) AS n FROM {t} GROUP BY cluster) USING (bc) GROUP BY id)"""
add(
    "silhouette", lambda s, f: kmeans.silhouette(exz(s, f), EXZ, "cluster", "row_id"),
    SIL.format(d=f"sqrt({D2})", t="exz"), d="silhouette", with_="exz",
)
add(
    "silhouette_sq", lambda s, f: kmeans.silhouette_sq(exz(s, f), EXZ), SIL.format(d=D2, t="exz"), d="silhouette", with_="exz",
)

CHOICE = """SELECT r.* EXCLUDE (cluster) FROM redc r CROSS JOIN
    (SELECT c, count(*) FILTER (power_watts >= c) >= count(*) FILTER (hour BETWEEN 18 AND 23) AS w FROM redt CROSS JOIN
      (SELECT quantile_cont(power_watts, 0.8::DOUBLE) AS c FROM redt) GROUP BY c)
    WHERE CASE WHEN w THEN power_watts >= c ELSE hour BETWEEN 18 AND 23 END"""
piece("pk", scaled_sql(f"(SELECT *, hostname || '|' || pci_bus_id || '|' || strftime(timestamp, '%Y%m%d%H%M%S') AS row_id FROM ({CHOICE}))", EX), "redc redt")
km_pieces("kp", "pk", [], EXZ, ROUNDS, "pk")
piece("kpdist", DIST.format(t="kp"), "kp")
add(
    "peak_reclustering", lambda s, f: kmeans.peak_reclustering(redt(s, f), EX)[1],
    TIGHT.format(r=RADIUS.format(t="kpdist")), d=RD, i="cluster size", with_="kpdist",
)


def full_and_peak(s, f):
    rows = settle(reading_key(redt(s, f)))
    full = kmeans.compactness(rows, EX)
    peak = kmeans.peak_reclustering(rows, EX)
    return kmeans.peak_vs_full(full, peak, EX, "row_id")


def four(t: str, col: str) -> str:
    return f"""SELECT 'inertia' AS metric, (SELECT sum(dist * dist) FROM {t}) AS {col} UNION ALL
    SELECT 'silhouette', ({SIL.format(d=f"sqrt({D2})", t=t)}) UNION ALL
    SELECT 'avg_cluster_dist', (SELECT avg(d) FROM (SELECT avg(dist) AS d FROM {t} GROUP BY cluster)) UNION ALL
    SELECT 'n_rows', (SELECT CAST(count(*) AS DOUBLE) FROM {t})"""


add(
    "peak_vs_full", full_and_peak,
    f"SELECT * FROM ({four('kmdist', 'full_dataset')}) JOIN ({four('kpdist', 'peak_subset')}) USING (metric)",
    d="full_dataset peak_subset", with_="kmdist kpdist",
)

# 135-137 projection
# Eigenvalues of a 3 x 3 covariance matrix in closed form (trigonometric solution), per group `g`; an
# eigenvector is the cross product of two rows of the matrix less its eigenvalue.
COV = """SELECT {g} AS g, count(*) AS n, avg({0}) AS m0, avg({1}) AS m1, avg({2}) AS m2, covar_pop({0}, {0}) AS a, covar_pop({1}, {1}) AS b,
    covar_pop({2}, {2}) AS c, covar_pop({0}, {1}) AS d, covar_pop({0}, {2}) AS e, covar_pop({1}, {2}) AS f FROM pts GROUP BY ALL"""
EIGEN = """SELECT * EXCLUDE (m, p, phi), m + 2 * p * cos(phi) AS v1, 3 * m - (m + 2 * p * cos(phi)) - (m + 2 * p * cos(phi + 2 * pi() / 3)) AS v2 FROM (SELECT *,
    acos(greatest(-1, least(1, (((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - f * e) + e * (d * f - (b - m) * e)) / (p * p * p)) / 2))) / 3 AS phi
    FROM (SELECT *, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM (SELECT *, (a + b + c) / 3 AS m FROM {t})))"""
piece("cov", COV.format(*Z, g="0"), "pts")
piece("eig", EIGEN.format(t="cov"), "cov")
piece("covpk", COV.format(*Z, g="is_peak"), "pts")
piece("eigpk", EIGEN.format(t="covpk"), "covpk")


def axis_sql(value: str) -> str:
    cross = f"SELECT m0, m1, m2, d * f - e * (b - {value}) AS x, e * d - (a - {value}) * f AS y, (a - {value}) * (b - {value}) - d * d AS z FROM eig"
    big = "CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END"
    return f"SELECT m0, m1, m2, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sign({big}) * sqrt(x * x + y * y + z * z) AS n FROM ({cross}))"


piece("axis1", axis_sql("v1"), "eig")
piece("axis2", axis_sql("v2"), "eig")
ON_AXIS = "({1} - {0}.m0) * {0}.x + ({2} - {0}.m1) * {0}.y + ({3} - {0}.m2) * {0}.z"
add(
    "pca_2d", lambda s, f: projection.pca_2d(pts(s, f), Z).select("row_id", "pca1", "pca2"),
    f"SELECT row_id, {ON_AXIS.format('axis1', *Z)} AS pca1, {ON_AXIS.format('axis2', *Z)} AS pca2 FROM pts CROSS JOIN axis1 CROSS JOIN axis2",
    d="pca1 pca2", i="row_id", with_="pts axis1 axis2",
)
add(
    "pca_explained", lambda s, f: projection.pca_explained(pts(s, f), Z),
    # Eigenvalues of the 3 x 3 covariance matrix in closed form (trigonometric solution).
    """WITH c AS (SELECT covar_pop({0}, {0}) AS a, covar_pop({1}, {1}) AS b, covar_pop({2}, {2}) AS c,
      covar_pop({0}, {1}) AS d, covar_pop({0}, {2}) AS e, covar_pop({1}, {2}) AS f FROM pts),
    q AS (SELECT *, (a + b + c) / 3 AS m, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2
      + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c),
    r AS (SELECT *, acos(greatest(-1, least(1, (((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - f * e) + e * (d * f - (b - m) * e)) / (p * p * p)) / 2))) / 3 AS phi FROM q),
    v AS (SELECT m + 2 * p * cos(phi) AS v1, m + 2 * p * cos(phi + 2 * pi() / 3) AS v3, 3 * m AS total FROM r)
    SELECT 1 AS component, v1 / total AS share FROM v UNION ALL SELECT 2, (total - v1 - v3) / total FROM v""".format(*Z),
    d="share", i="component", with_="pts",
)
add(
    "pca_by_peak",
    lambda s, f: projection.pca_by_peak(pts(s, f), Z, refit=True).groupBy("is_peak").agg(
        F.var_pop("pca1").alias("var1"), F.var_pop("pca2").alias("var2"), F.count(F.lit(1)).alias("n")
    ),
    # The variance along a component is its eigenvalue.
    "SELECT g AS is_peak, v1 AS var1, v2 AS var2, n FROM eigpk", d="var1 var2", i="is_peak n", with_="eigpk",
)


# ---- density -----------------------------------------------------------------------------------


def db_pieces(tag: str, source: str, eps: str, needs: str, on: str = "true") -> None:
    """Brute-force neighbour lists over cells of side eps, then components to a fixed point.

    `eps` is a table (run, eps); the piece `<tag>` has run, eps, row_id, cluster for all rows.
    """
    xs = [f"x{i}" for i in range(len(Z))]
    cols = ", ".join(f"{c} AS {x}" for c, x in zip(Z, xs))
    cells = ", ".join(f"CAST(floor({c} / eps) AS BIGINT) AS g{i}" for i, c in enumerate(Z))
    piece(f"{tag}p", f"SELECT e.run, e.eps, row_id AS id, {cols}, {cells} FROM {source} s JOIN {eps} e ON {on}", f"{source} {eps} {needs}")
    steps = " ".join(f"CROSS JOIN (VALUES (-1), (0), (1)) s{i}(o{i})" for i in range(len(Z)))
    match = " AND ".join(f"b.g{i} = a.n{i}" for i in range(len(Z)))
    d2 = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    moved = ", ".join(f"g{i} + o{i} AS n{i}" for i in range(len(Z)))
    piece(
        f"{tag}n",
        f"""SELECT a.run, a.id AS a, b.id AS b FROM (SELECT *, {moved} FROM {tag}p {steps}) a
        JOIN {tag}p b ON a.run = b.run AND {match} WHERE {d2} <= a.eps * a.eps""",
        f"{tag}p",
    )
    piece(f"{tag}c", f"SELECT run, a AS id FROM {tag}n GROUP BY run, a HAVING count(*) >= 20", f"{tag}n")
    piece(
        f"{tag}e",
        f"""SELECT n.run, n.a, n.b FROM {tag}n n JOIN {tag}c u ON u.run = n.run AND u.id = n.a
        JOIN {tag}c w ON w.run = n.run AND w.id = n.b""",
        f"{tag}n {tag}c",
    )
    piece(
        f"{tag}cc",
        f"""USING KEY (run, id) AS (SELECT run, id, id FROM {tag}c UNION SELECT e.run, e.b, min(x.comp) FROM {tag}cc x
        JOIN {tag}e e ON e.run = x.run AND e.a = x.id JOIN recurring.{tag}cc r ON r.run = e.run AND r.id = e.b
        WHERE x.comp < r.comp GROUP BY e.run, e.b)""",
        f"{tag}c {tag}e",
    )
    piece(f"{tag}l", f"SELECT run, id, dense_rank() OVER (PARTITION BY run ORDER BY comp) - 1 AS cluster FROM {tag}cc", f"{tag}cc")
    piece(
        tag,
        f"""SELECT p.run, p.eps, p.id AS row_id, coalesce(c.cluster, b.cluster, -1) AS cluster FROM {tag}p p
        LEFT JOIN {tag}l c ON c.run = p.run AND c.id = p.id
        LEFT JOIN (SELECT n.run, n.a, min(l.cluster) AS cluster FROM {tag}n n JOIN {tag}l l ON l.run = n.run AND l.id = n.b
          GROUP BY n.run, n.a) b ON b.run = p.run AND b.a = p.id""",
        f"{tag}l",
    )
    piece(
        f"{tag}s",
        f"""SELECT *, 1 - noise_share AS inlier_ratio, CASE WHEN n_clusters > 1 THEN (1 - noise_share) * (ln(n_clusters) + 1) ELSE 0 END AS score
        FROM (SELECT run, eps, count(*) AS n, count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters,
        count(*) FILTER (cluster = -1) / count(*) AS noise_share FROM {tag} GROUP BY run, eps)""",
        tag,
    )


def tune_pieces(tag: str, source: str, run: str, needs: str) -> None:
    """k-distances, start eps and at most five tries per run; `<tag>` has the final labels."""
    d2 = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in Z)
    piece(f"{tag}src", f"SELECT *, {run} AS run FROM {source}", needs)
    piece(
        f"{tag}kd",
        f"""SELECT a.run, a.row_id, sqrt(list_extract(min({d2}, 20), 20)) AS k_dist
        FROM {tag}src a JOIN {tag}src b ON a.run = b.run GROUP BY a.run, a.row_id""",
        f"{tag}src",
    )
    piece(f"{tag}e0", f"SELECT run, CASE WHEN e > 0 THEN e ELSE 0.1 END AS eps FROM (SELECT run, quantile_cont(k_dist, 0.9::DOUBLE) AS e FROM {tag}kd GROUP BY run)", f"{tag}kd")
    good = "noise_share < 0.5 AND n_clusters > 1"
    for i in range(6):
        db_pieces(f"{tag}{i}d", f"{tag}src", f"{tag}e{i}", "", "e.run = s.run")
        piece(
            f"{tag}e{i + 1}",
            f"SELECT run, eps * CASE WHEN noise_share >= 0.5 THEN 1.5 ELSE 0.8 END::DOUBLE AS eps FROM {tag}{i}ds WHERE NOT ({good})",
            f"{tag}{i}ds",
        )
    parts = [f"SELECT d.*, s.n_clusters, s.noise_share, 1 AS converged FROM {tag}{i}d d JOIN {tag}{i}ds s USING (run) WHERE {good}" for i in range(5)]
    parts.append(f"SELECT d.*, s.n_clusters, s.noise_share, 0 AS converged FROM {tag}5d d JOIN {tag}5ds s USING (run)")
    piece(tag, " UNION ALL ".join(parts), " ".join(f"{tag}{i}ds" for i in range(6)))


def eps_table(name: str, values: list[float]) -> None:
    piece(name, "SELECT * FROM (VALUES " + ", ".join(f"('{e}', {e}::DOUBLE)" for e in values) + ") t(run, eps)", "")


eps_table("one", [0.25])
eps_table("wide", [0.5])
eps_table("gridv2", analyses.GRID_V2)
eps_table("gridfin", analyses.GRID_FINAL)
db_pieces("dba", "pts", "one", "")
db_pieces("dbw", "pts", "wide", "")
db_pieces("dbg", "pts", "gridv2", "")
db_pieces("dbf", "pts", "gridfin", "")
tune_pieces("au", "pts", "'all'", "pts")
tune_pieces("ap", "pts", "CAST(is_peak AS VARCHAR)", "pts")


@stored
def db25(s, f):
    return density.dbscan(pts(s, f), Z, "row_id", 0.25)


@stored
def kd(s, f):
    return density.k_distance(pts(s, f), Z, "row_id")


add("dbscan", lambda s, f: db25(s, f).select("row_id", "cluster"), "SELECT row_id, cluster FROM dba", i="row_id cluster", with_="dba")
add(
    "dbscan_full", lambda s, f: density.dbscan_full(pts(s, f), Z, "row_id", 0.5).select("row_id", "cluster"),
    "SELECT row_id, cluster FROM dbw", i="row_id cluster", with_="dbw",
)
add("k_distance", kd, "SELECT row_id, k_dist FROM aukd", d="k_dist", i="row_id", with_="aukd")
add("eps_from_kdist", lambda s, f: density.eps_from_kdist(kd(s, f)), "SELECT eps FROM aue0", d="eps", with_="aue0")
add(
    "eps_autotune",
    lambda s, f: density.eps_autotune(pts(s, f), Z, "row_id", density.eps_from_kdist(kd(s, f)).first()["eps"]),
    "SELECT DISTINCT eps, converged, n_clusters, noise_share FROM au", d="eps noise_share", i="converged n_clusters", with_="au",
)


@stored
def grid_scores(s, f):
    return density.eps_grid_scores(pts(s, f), Z, "row_id", analyses.GRID_V2)


add(
    "eps_grid_scores", grid_scores, "SELECT eps, inlier_ratio, n_clusters, score FROM dbgs",
    d="eps inlier_ratio score", i="n_clusters", with_="dbgs",
)
add(
    "eps_grid_select", lambda s, f: density.eps_grid_select(grid_scores(s, f)),
    "SELECT eps, score, n_clusters FROM dbgs ORDER BY score DESC, eps LIMIT 1", d="eps score", i="n_clusters", with_="dbgs",
)
DNEAR = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in Z)
NEAR = """SELECT a.row_id, coalesce(min({{'d': {d}, 'i': b.row_id, 'c': b.cluster}}).c, -1) AS cluster FROM
    (SELECT * FROM pts CROSS JOIN (SELECT eps AS e FROM {e})) a LEFT JOIN (SELECT p.*, l.cluster FROM pts p JOIN {l} l USING (row_id) WHERE l.cluster <> -1) b
    ON a.{z} BETWEEN b.{z} - a.e AND b.{z} + a.e AND {d} <= a.e * a.e GROUP BY a.row_id"""
add(
    "nn_label_join",
    lambda s, f: density.nn_label_join(
        pts(s, f), db25(s, f).select("row_id", *Z, "cluster"), Z, 0.25
    ).select("row_id", "cluster"),
    NEAR.format(d=DNEAR, e="one", l="dba", z=Z[0]), i="row_id cluster", with_="pts dba",
)
add(
    "dbscan_scalable", lambda s, f: density.dbscan_scalable(pts(s, f), Z)[0].select("row_id", "cluster"),
    "SELECT row_id, cluster FROM au", i="row_id cluster", with_="au",
)
add(
    "dbscan_peak_nonpeak", lambda s, f: density.dbscan_peak_nonpeak(pts(s, f), Z)[0].select("row_id", "is_peak", "cluster"),
    "SELECT row_id, CAST(run AS INTEGER) AS is_peak, cluster FROM ap", i="row_id is_peak cluster", with_="ap",
)
piece("dbfbest", "SELECT run, eps FROM dbfs ORDER BY score DESC, eps LIMIT 1", "dbfs")
piece("fbest_labels", "SELECT row_id, cluster FROM dbf WHERE run = (SELECT run FROM dbfbest)", "dbf dbfbest")
add(
    "dbscan_grid", lambda s, f: density.dbscan_grid(pts(s, f), Z, analyses.GRID_FINAL)[0].select("row_id", "cluster"),
    "SELECT row_id, cluster FROM fbest_labels", i="row_id cluster", with_="fbest_labels",
)


# ---- streaming ---------------------------------------------------------------------------------


def streamed(s, f):
    path = scratch_path(s, "stream")
    rows = tel(s, f)
    reports.write_tables(rows.repartitionByRange(4, "timestamp"), path)
    return s.readStream.schema(rows.schema).parquet(path)


def arriving(s, f):
    """Readings that arrive up to six hours late, in six files of one micro-batch each, and a closing reading."""
    path = scratch_path(s, "stream")
    rows = tel(s, f)
    late = F.expr("timestamp + make_interval(0, 0, 0, 0, 0, 0, pmod(row_id * 7919, 21600))")
    ranged = rows.withColumn("_at", late).repartitionByRange(6, "_at", "row_id")
    parts = settle(ranged.withColumn("_file", F.spark_partition_id()).drop("_at"))
    last = rows.agg(F.max("timestamp").alias("timestamp")).select(
        *(F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema if c.name not in ("timestamp", "hostname", "pci_bus_id")),
        F.lit("").alias("hostname"), F.lit("").alias("pci_bus_id"), (F.col("timestamp") + F.expr("INTERVAL 9 DAYS")).alias("timestamp"),
    )
    for k in range(6):
        reports.write_tables(parts.where(F.col("_file") == k).drop("_file").coalesce(1), path, mode="append")
    reports.write_tables(last.select(*rows.columns).coalesce(1), path, mode="append")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


add(
    "stream_gpu_downsample",
    lambda s, f: jobs.run_latest(s, jobs.stream_gpu_downsample(streamed(s, f)), [*GPU_KEYS, "timestamp"], "stream_out"),
    """SELECT hostname, pci_bus_id, w AS timestamp, avg(power_watts) AS power_watts, sum(power_watts) AS power_sum, count(*) AS n
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, timestamp) AS w FROM tel) GROUP BY hostname, pci_bus_id, w""",
    d="power_watts power_sum", i="n", t="timestamp", with_="tel",
)
add(
    "stream_features",
    lambda s, f: jobs.stream_features(arriving(s, f), scratch_path(s, "features"), "6 hours", piece_seconds=86_400).select(
        "row_id", "gpu_id", "rolling_mean_power", "power_delta"
    ),
    "SELECT row_id, gpu_id, rolling_mean_power, power_delta FROM feat",
    d="rolling_mean_power power_delta", i="row_id", with_="feat",
)
add(
    "stream_iqr_flag",
    lambda s, f: jobs.run_and_read(
        s, jobs.stream_iqr_flag(streamed(s, f), outliers.fences(tel(s, f), GPU_KEYS)), "stream_out"
    ).select("row_id", "is_outlier"),
    """SELECT row_id, CAST(power_watts < q1 - 1.5 * (q3 - q1) OR power_watts > q3 + 1.5 * (q3 - q1) AS INTEGER) AS is_outlier
    FROM tel JOIN (SELECT hostname, pci_bus_id, quantile_cont(power_watts, 0.25::DOUBLE) AS q1, quantile_cont(power_watts, 0.75::DOUBLE) AS q3
    FROM tel GROUP BY ALL) USING (hostname, pci_bus_id)""",
    i="row_id is_outlier", with_="tel",
)


# Fences that roll forward: sketches of two weeks, and the ranks that their quartiles have among the readings.
@stored
def hour_sketches(s, f):
    return outliers.value_sketches(tel(s, f), GPU_KEYS)


def rolling_fences(s, f):
    first, end = "2024-01-08", "2024-01-22"
    bounds = settle(outliers.sketched_fences(hour_sketches(s, f), GPU_KEYS, first, end))
    rows = tel(s, f).where(f"timestamp >= '{first}' AND timestamp < '{end}'").join(bounds.drop("n"), GPU_KEYS)
    share = lambda test: F.avg(F.expr(test).cast("double"))
    slack = F.lit(outliers.SKETCH_RANK) + 1 / F.count(F.lit(1))
    near = lambda q, p: ((share(f"power_watts < {q}") <= p + slack) & (share(f"power_watts <= {q}") >= p - slack)).cast("int")
    return rows.groupBy(*GPU_KEYS).agg(F.count(F.lit(1)).alias("n"), near("q1", 0.25).alias("q1_near"), near("q3", 0.75).alias("q3_near"))


add(
    "rolling_fences", rolling_fences,
    """SELECT hostname, pci_bus_id, count(*) AS n, 1 AS q1_near, 1 AS q3_near FROM tel
    WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-22' GROUP BY ALL""",
    i="n q1_near q3_near", with_="tel",
)
