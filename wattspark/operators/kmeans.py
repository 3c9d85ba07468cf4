"""K-Means (random starts, and a deterministic form), its quality measures, and rank labels."""

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.blocks import together
from wattspark.operators.common import (
    attach_one_row,
    broadcast_if_small,
    keep,
    settle,
    sq_distance,
)
from wattspark.operators.features import label_encode
from wattspark.operators.patterns import rank_clusters
from wattspark.operators.peaks import peak_choice
from wattspark.operators.quantiles import quantiles
from wattspark.operators.scaling import scaled_names, standardize
from wattspark.schema import POWER, RANK_LABELS

OUTLIER_FEATURES = [POWER, "hour", "day_num", "encoded_pci_bus_id"]
# Of the exact silhouette: rows of a block at most and (with many clusters or few rows) at least, sums of a block at most,
# blocks of a small table, distances at once.
BLOCK, LEAST_BLOCK, PAIR_SUMS, SPREAD, TILE = 32_768, 4096, 2**22, 12, (32, 1024)
NO_CLASS = np.iinfo(np.int64).max  # sorts last


def kmeans(
    df: DataFrame, feats: list[str], k: int = 3, seeds: range = range(42, 52), steps: int = 10_000
) -> tuple[DataFrame, float]:
    """Best of several random-start K-Means fits: rows with `cluster`, and the cost.

    A fit ends when no centre moves by more than `1e-6`; `steps` only guards against endless loops.
    """
    data = keep(VectorAssembler(inputCols=feats, outputCol="_features").transform(df))
    best = None
    for seed in seeds:
        model = KMeans(k=k, seed=seed, maxIter=steps, tol=1e-6, featuresCol="_features", predictionCol="cluster").fit(data)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = (model, cost)
    return best[0].transform(data).drop("_features"), best[1]


def _nearest(k: int, feats: list[str]) -> str:
    """SQL text: index of the nearest centroid column set, ties to the lowest."""
    dist = [
        " + ".join(f"(`{f}` - _c{j}_{i}) * (`{f}` - _c{j}_{i})" for i, f in enumerate(feats))
        for j in range(k)
    ]
    d = [f"_d{j}" for j in range(k)]
    least = f"least({', '.join(d)})" if k > 1 else d[0]
    cases = " ".join(f"WHEN _d{j} <= {least} THEN {j}" for j in range(k))
    return dist, f"CASE {cases} END"


def _assign(df: DataFrame, centroids: DataFrame, keys: list[str], feats: list[str], k: int) -> DataFrame:
    dist, pick = _nearest(k, feats)
    joined = df.join(centroids, keys) if keys else attach_one_row(df, centroids)
    # A centroid of a class that never had a row is NULL and attracts nothing.
    with_d = joined.selectExpr(
        "*", *[f"coalesce({e}, double('infinity')) AS _d{j}" for j, e in enumerate(dist)]
    )
    return with_d.selectExpr("*", f"{pick} AS _cluster")


def _centroids(assigned: DataFrame, keys: list[str], feats: list[str], k: int, first: bool) -> DataFrame:
    """One row per group with k * d centroid columns, from one partial aggregation.

    After the start also the centroids the rows were assigned by (`_p...`), how many rows changed
    their class, the cost, and the cost of the round before.
    """
    aggs = []
    for j in range(k):
        for i, f in enumerate(feats):
            mean = f"avg(CASE WHEN _cluster = {j} THEN `{f}` END)"
            old = f"max(_c{j}_{i})"
            aggs.append(F.expr(mean if first else f"coalesce({mean}, {old})").alias(f"_c{j}_{i}"))
            aggs.append((F.lit(None).cast("double") if first else F.expr(old)).alias(f"_p{j}_{i}"))
    if first:
        aggs.append(F.lit(float("inf")).alias("_cost"))
    else:
        least = f"least({', '.join(f'_d{j}' for j in range(k))})" if k > 1 else "_d0"
        aggs.append(F.expr("count_if(_cluster <> _was)").alias("_moved"))
        aggs.append(F.expr(f"sum({least})").alias("_cost"))
        aggs.append(F.max("_cost").alias("_before"))
    return assigned.groupBy(*keys).agg(*aggs)


def kmeans_fit(df: DataFrame, keys: list[str], feats: list[str], k: int, init_by: str) -> DataFrame:
    """Centroids per group after deterministic Lloyd rounds, until no row changes its class.

    Start classes split the rows at the quantiles i/k of `init_by`; an empty class keeps its
    centroid. All groups move in the same plan; each round is one partial aggregation, and its
    small result is written so that the lineage does not grow with the rounds. A round assigns every
    row by the last and by the current centroids. A group is done when no row changes, or when its
    cost no longer falls (distances equal up to rounding), so the loop always ends.
    """
    if k > 1:
        cuts = [f"_q{i}" for i in range(1, k)]
        q = settle(quantiles(df, keys, init_by, [i / k for i in range(1, k)], cuts).drop("n"))
        joined = df.join(q, keys) if keys else attach_one_row(df, q)
        cases = " ".join(f"WHEN `{init_by}` <= {c} THEN {i}" for i, c in enumerate(cuts))
        start = joined.selectExpr("*", f"CASE {cases} ELSE {k - 1} END AS _cluster")
    else:
        start = df.withColumn("_cluster", F.lit(0))
    current = settle(_centroids(start, keys, feats, k, first=True))
    groups = current.count() if keys else 1
    dist, _ = _nearest(k, feats)
    last = [re.sub(r"- _c", "- _p", d) for d in dist]
    least = f"least({', '.join(f'_o{j}' for j in range(k))})" if k > 1 else "_o0"
    was = " ".join(f"WHEN _o{j} <= {least} THEN {j}" for j in range(k))
    rounds = 0
    while True:
        side = current.drop("_moved", "_before")
        side = broadcast_if_small(side, groups) if keys else side
        assigned = (
            _assign(df, side, keys, feats, k)
            .selectExpr("*", *[f"coalesce({e}, double('infinity')) AS _o{j}" for j, e in enumerate(last)])
            .selectExpr("*", f"CASE {was} END AS _was")
        )
        current = settle(_centroids(assigned, keys, feats, k, first=False))
        rounds += 1
        if rounds > 1 and current.where("_moved > 0 AND _cost < _before").isEmpty():
            return current.select(*keys, *[f"_c{j}_{i}" for j in range(k) for i in range(len(feats))])


def kmeans_det(
    df: DataFrame,
    feats: list[str],
    k: int = 3,
    init_by: str = POWER,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rows with `cluster`, the rank (0-based) of their centroid class by mean `init_by`."""
    keys = keys or []
    data = keep(df)
    centroids = kmeans_fit(data, keys, feats, k, init_by)
    # For one row per group the centroids may be sent to all tasks after their count is known.
    side = broadcast_if_small(centroids, centroids.count()) if keys else centroids
    drop = [f"_c{j}_{i}" for j in range(k) for i in range(len(feats))] + [
        f"_d{j}" for j in range(k)
    ]
    assigned = keep(_assign(data, side, keys, feats, k).drop(*drop))
    means = assigned.groupBy(*keys, "_cluster").agg(F.avg(init_by).alias("_mean"))
    ranks = settle(
        rank_clusters(means, keys, "_cluster", "_mean").select(
            *keys, "_cluster", (F.col("rank") - 1).cast("int").alias("cluster")
        )
    )
    return assigned.join(ranks, [*keys, "_cluster"]).drop("_cluster")


def rank_label(df: DataFrame, keys: list[str], cluster: str = "cluster") -> DataFrame:
    """Add `<cluster>_label`: usage names when the group has three clusters, else its rank."""
    found = settle(
        df.groupBy(*keys).agg(F.count_distinct(F.when(F.col(cluster) >= 0, F.col(cluster))).alias("_k"))
    )
    joined = df.join(found, keys) if keys else attach_one_row(df, found)
    names = F.array(*[F.lit(x) for x in RANK_LABELS])
    label = (
        F.when(F.col(cluster) < 0, "None")
        .when(F.col("_k") == 3, F.get(names, F.col(cluster)))
        .otherwise(F.concat(F.lit("Cluster Rank "), (F.col(cluster) + 1).cast("string")))
    )
    return joined.withColumn(f"{cluster}_label", label).drop("_k")


def kmeans_by_group(
    df: DataFrame,
    keys: list[str],
    feats: list[str],
    k: int = 3,
    name: str = "cluster",
) -> DataFrame:
    """Scaling, K-Means and rank labels within every group at once.

    Groups with fewer rows than classes get cluster -1 and label 'None'.
    """
    sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    sized = df.join(sizes, keys)
    big = sized.where(F.col("_size") >= k).drop("_size")
    small = sized.where(F.col("_size") < k).drop("_size")
    scaled, _ = standardize(big, feats, keys)
    done = kmeans_det(scaled, scaled_names(feats), k, POWER, keys).drop(*scaled_names(feats))
    named = rank_label(done.withColumnRenamed("cluster", name), keys, name)
    rest = small.withColumns({name: F.lit(-1), f"{name}_label": F.lit("None")})
    return named.unionByName(rest)


def outlier_kmeans_global(outliers: DataFrame) -> DataFrame:
    """Cluster each subset's outliers on power, hour, day and encoded bus id, with rank labels."""
    coded = label_encode(outliers, "pci_bus_id", ["subset"])
    return kmeans_by_group(coded, ["subset"], OUTLIER_FEATURES, name="global_cluster")


def outlier_back_join(outliers: DataFrame, assignment: DataFrame, id: str) -> DataFrame:
    """Bring the cluster columns of another assignment back to the outlier rows."""
    new = [c for c in assignment.columns if c not in outliers.columns]
    return outliers.join(assignment.select(id, *new), id, "left")


def centroid_distance(df: DataFrame, feats: list[str], cluster: str = "cluster") -> DataFrame:
    """Add `dist`, the Euclidean distance of each row to the mean of its cluster."""
    means = settle(
        df.groupBy(cluster).agg(*[F.avg(f).alias(f"_m{i}") for i, f in enumerate(feats)])
    )
    d2 = sq_distance(
        [F.col(f) for f in feats], [F.col(f"_m{i}") for i in range(len(feats))]
    )
    return (
        df.join(means, cluster)
        .withColumn("dist", F.sqrt(d2))
        .drop(*[f"_m{i}" for i in range(len(feats))])
    )


def inertia(dist: DataFrame) -> DataFrame:
    return dist.agg(F.sum(F.col("dist") * F.col("dist")).alias("inertia"))


def cluster_radius(dist: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: size, mean, max and population std of the distance, mean power."""
    return dist.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("dist").alias("avg_dist"),
        F.max("dist").alias("max_dist"),
        F.stddev_pop("dist").alias("std_dist"),
        F.avg(POWER).alias("mean_power_W"),
    )


def tightness(radius: DataFrame) -> DataFrame:
    """'Tight' when the mean distance is below the median over the (few) clusters."""
    mid = radius.agg(F.median("avg_dist").alias("_mid"))
    return (
        attach_one_row(radius, mid)
        .withColumn(
            "tightness", F.when(F.col("avg_dist") < F.col("_mid"), "Tight").otherwise("Spread")
        )
        .drop("_mid")
    )


def _segments(c: np.ndarray, step: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Pieces of at most `step` of the sorted classes `c`: start, end, number of the first class, where its classes begin."""
    number = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]])) if len(c) else c
    pieces = []
    for s in range(0, len(c), step):
        part = number[s : s + step]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        pieces.append((s, s + len(part), int(part[0]), begins))
    return pieces


def _pair_sums(a: tuple, b: tuple, both: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per point of `a` the summed distance to each class of `b`, and (if `both`) the other way: points, classes, sums.

    A side is (coordinates by feature, classes, point numbers), sorted by class; points without a class come last
    and are summed for, but not summed up. Tiles of `TILE` fit a core's cache, and each distance is computed once.
    """
    (xa, ca, pa_), (xb, cb, pb) = a, b
    na, nb = (int((c != NO_CLASS).sum()) for c in (ca, cb))
    ga, gb = np.unique(ca[:na]), np.unique(cb[:nb])
    to_b, to_a = np.zeros((len(ca), len(gb))), np.zeros((len(cb), len(ga)))
    columns = _segments(cb, TILE[1])
    d2_, diff_ = np.empty(TILE), np.empty(TILE)  # made once: fresh ones would cost as much as the distances
    for s, e, first_a, begin_a in _segments(ca, TILE[0]):
        held_a = begin_a[begin_a < na - s]
        for t, u, first_b, begin_b in columns:
            d2, diff = d2_[: e - s, : u - t], diff_[: e - s, : u - t]
            np.subtract(xa[0, s:e, None], xb[0, None, t:u], out=d2)
            np.multiply(d2, d2, out=d2)
            for f in range(1, len(xa)):
                np.subtract(xa[f, s:e, None], xb[f, None, t:u], out=diff)
                np.multiply(diff, diff, out=diff)
                np.add(d2, diff, out=d2)
            dist = np.sqrt(d2, out=d2)
            held_b = begin_b[begin_b < nb - t]
            if len(begin_b) == len(held_b) == 1:
                to_b[s:e, first_b] += dist.sum(axis=1)
            elif len(held_b):
                to_b[s:e, first_b : first_b + len(held_b)] += np.add.reduceat(dist[:, : nb - t], held_b, axis=1)
            if both and len(begin_a) == len(held_a) == 1:
                to_a[t:u, first_a] += dist.sum(axis=0)
            elif both and len(held_a):
                to_a[t:u, first_a : first_a + len(held_a)] += np.add.reduceat(dist[: na - s], held_a, axis=0).T
    out = [(pa_, gb, to_b)]
    return [*out, (pb, ga, to_a)] if both else out


def _packed(df: DataFrame, d: int, blocks: int) -> DataFrame:
    """One row per block: coordinates by feature, classes and point numbers as bytes, sorted by class."""
    xs = [f"_x{i}" for i in range(d)]

    def pack(t: pa.Table) -> pa.Table:
        c = t["_c"].fill_null(NO_CLASS).to_numpy()
        order = np.argsort(c, kind="stable")
        x = np.stack([t[x].cast(pa.float64()).fill_null(np.nan).to_numpy()[order] for x in xs])
        found = [x.tobytes(), c[order].astype(np.int64).tobytes(), t["_p"].to_numpy()[order].tobytes()]
        return pa.table({"_b": t["_b"][:1], **{n: pa.array([v], pa.binary()) for n, v in zip(("_x", "_c", "_p"), found)}})

    table = df.select("_b", "_p", F.col("_c").cast("long").alias("_c"), *xs)
    return settle(table.repartition(blocks, "_b").groupBy("_b").applyInArrow(pack, "_b int, _x binary, _c binary, _p binary"))


def silhouette(
    df: DataFrame, feats: list[str], cluster: str, id: str, block: int | None = None
) -> DataFrame:
    """Mean Euclidean silhouette over all rows, exact.

    The work is quadratic by definition: rows are cut into even blocks, each pair of blocks is one group that
    computes its distances once for both sides; `silhouette_sq` is linear. The size of a block depends on the
    number of clusters, as a pair gives a sum per row and cluster.
    """
    d = len(feats)
    classes = F.col(cluster).cast("int")
    sizes = settle(df.groupBy(classes.alias("_c")).agg(F.count(F.lit(1)).alias("_n")))
    rows, several = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    rows = rows or 0
    block = block or min(BLOCK, max(LEAST_BLOCK, min(PAIR_SUMS // max(several, 1), rows // SPREAD)))
    blocks = max(1, -(-rows // block))
    # Numbers are fixed by the written table.
    laid = df.select(F.col(id).alias("_id"), classes.alias("_c"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
    tagged = settle(
        laid.repartition(blocks).select("*", F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().alias("_p"))
    )
    packed = _packed(tagged, d, blocks)
    # A block meets itself and every later one, in which it is the left side.
    number = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = packed.withColumn("_o", number)
    left = spread.where("_b <= _o").select(F.col("_b").alias("_i"), F.col("_o").alias("_j"), "_x", "_c", "_p")
    right = spread.where("_b > _o").select(F.col("_o").alias("_i"), F.col("_b").alias("_j"), "_x", "_c", "_p")

    def side(t: pa.Table) -> tuple:
        x, c, p = (np.frombuffer(t[n][0].as_py(), dtype) for n, dtype in (("_x", float), ("_c", np.int64), ("_p", np.int64)))
        return x.reshape(d, -1), c, p

    def partial(a: pa.Table, b: pa.Table) -> pa.Table:
        left = side(a)
        found = _pair_sums(left, side(b) if b.num_rows else left, b.num_rows > 0)
        p = [np.repeat(p, len(g)) for p, g, _ in found]
        c = [np.tile(g, len(p)) for p, g, _ in found]
        s = [sums.ravel() for _, _, sums in found]
        return pa.table({"_p": np.concatenate(p), "_c": np.concatenate(c).astype(np.int32), "_s": np.concatenate(s)})

    parts = together(left, right, ["_i", "_j"], blocks * (blocks + 1) // 2 if blocks < 100 else 5000).applyInArrow(
        partial, "_p bigint, _c int, _s double"
    )
    # Rows whose id repeats are one, with the sums of all of them.
    point = parts.groupBy("_p", "_c").agg(F.sum("_s").alias("_s"))
    sums = point.join(tagged.select("_p", "_id"), "_p").groupBy("_id", "_c").agg(F.sum("_s").alias("_s")).join(sizes, "_c")
    own = tagged.select("_id", F.col("_c").alias("_own"))
    mine = F.col("_c") == F.col("_own")
    scored = (
        sums.join(own, "_id")
        .groupBy("_id")
        .agg(
            F.max(F.when(mine, F.col("_n"))).alias("_own_n"),
            F.max(F.when(mine & (F.col("_n") > 1), F.col("_s") / (F.col("_n") - 1))).alias("_a"),
            F.min(F.when(~mine, F.col("_s") / F.col("_n"))).alias("_near"),
        )
    )
    score = F.when(F.col("_own_n") == 1, 0.0).otherwise(
        F.when(
            F.greatest("_a", "_near") > 0,
            (F.col("_near") - F.col("_a")) / F.greatest("_a", "_near"),
        ).otherwise(0.0)
    )
    return scored.agg(F.avg(score).alias("silhouette"))


def silhouette_sq(df: DataFrame, feats: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, linear time.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.m + s, where m is the cluster mean
    and s its mean squared norm, so only k rows of sums are shared.
    """
    norm = sq_distance([F.col(f) for f in feats], [F.lit(0.0)] * len(feats))
    sums = df.groupBy(F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(norm).alias("_s"),
        *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(feats)],
    )
    table = settle(
        sums.agg(
            F.collect_list(
                F.struct("_c", "_n", "_s", F.array(*[f"_m{i}" for i in range(len(feats))]).alias("_m"))
            ).alias("_t")
        )
    )

    def mean_d2(c):
        dot = None
        for i, f in enumerate(feats):
            part = F.col(f) * c["_m"][i]
            dot = part if dot is None else dot + part
        return F.greatest(F.lit(0.0), norm - 2 * dot + c["_s"])

    rows = attach_one_row(df, table)
    own = F.filter("_t", lambda c: c["_c"] == F.col(cluster))[0]
    others = F.filter("_t", lambda c: c["_c"] != F.col(cluster))
    rows = rows.withColumn("_own_n", own["_n"])
    inside = F.when(F.col("_own_n") > 1, mean_d2(own) * F.col("_own_n") / (F.col("_own_n") - 1))
    rows = rows.withColumn("_a", inside).withColumn(
        "_near", F.array_min(F.transform(others, mean_d2))
    )
    top = F.greatest("_a", "_near")
    score = F.when(F.col("_own_n") == 1, 0.0).otherwise(
        F.when(top > 0, (F.col("_near") - F.col("_a")) / top).otherwise(0.0)
    )
    return rows.agg(F.avg(score).alias("silhouette"))


def compactness(
    df: DataFrame, feats: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Scale, cluster and measure: (rows with cluster and distance, radius table)."""
    scaled, _ = standardize(df, feats)
    z = scaled_names(feats)
    dist = keep(centroid_distance(kmeans_det(scaled, z), z))
    return dist, tightness(settle(cluster_radius(dist)))


def peak_reclustering(df: DataFrame, feats: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same on the larger peak subset, with a scaler fitted on that subset."""
    return compactness(peak_choice(df), feats)


def peak_vs_full(
    full: tuple[DataFrame, DataFrame],
    peak: tuple[DataFrame, DataFrame],
    feats: list[str],
    id: str,
    scalable: bool = False,
) -> DataFrame:
    """Inertia, silhouette, mean cluster distance and rows of two runs, one row per metric."""
    z = scaled_names(feats)

    def metrics(run: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
        dist, radius = run
        score = silhouette_sq(dist, z) if scalable else silhouette(dist, z, "cluster", id)
        row = (
            inertia(dist)
            .crossJoin(F.broadcast(score))
            .crossJoin(F.broadcast(radius.agg(F.avg("avg_dist").alias("avg_cluster_dist"))))
            .crossJoin(F.broadcast(dist.agg(F.count(F.lit(1)).cast("double").alias("n_rows"))))
        )
        pairs = [
            F.struct(F.lit(m).alias("metric"), F.col(m).alias(name))
            for m in ("inertia", "silhouette", "avg_cluster_dist", "n_rows")
        ]
        return row.select(F.inline(F.array(*pairs)))

    return metrics(full, "full_dataset").join(metrics(peak, "peak_subset"), "metric")
