"""Blocks of nearby points, and exact searches that compare only blocks a point's ball reaches.

Rows with equal coordinates are one weighted point. The points of a `part` (a subset of rows) are laid along a
space-filling curve and cut into blocks of about `BLOCK` points. A search works within a point's own block first;
the point goes on to another block only when the ball that is left meets that block's bounding box, so the data
that moves grows with the rows. Within a task leaves of `LEAF` points are skipped by their boxes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.operators import boxtree
from wattspark.operators.common import settle

BLOCK = 10_000
LEAF = 32
SUB_BITS = 9  # of a point's number within a small box: a block's own box overlaps with many others, its small boxes with few
SLACK = 1 + 1e-9  # box gaps are rounded, the distances decide


@dataclass
class Blocks:
    d: int
    count: int  # about the number of blocks
    points: DataFrame  # part, _b, _p (number along the curve), x0.., w (rows at this place), id (the smallest)
    boxes: DataFrame  # part, _b, n (rows), lo0.., hi0..
    copies: DataFrame | None  # part, _p, id of all rows that share a place with others
    lost: DataFrame  # part, id of rows without a whole position
    odd: DataFrame | None  # part, _p of places whose id is null or names another place too
    subs: DataFrame  # part, _b, _subs: lo0.., hi0.. of each small box of the block, one after the other


def axes(d: int, name: str = "x") -> list[str]:
    return [f"{name}{i}" for i in range(d)]


def build(rows: DataFrame, d: int, block: int = BLOCK) -> Blocks:
    """The blocks of `rows` (part, id, x0..)."""
    xs = axes(d)
    whole = " AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in xs)
    good = rows.where(whole)
    uniq = settle(good.groupBy("part", *xs).agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id")))
    lo, hi = axes(d, "lo"), axes(d, "hi")
    bounds = [F.min(x).alias(n) for x, n in zip(xs, lo)] + [F.max(x).alias(n) for x, n in zip(xs, hi)]
    coded = uniq.join(settle(uniq.groupBy("part").agg(*bounds)), "part").withColumn("_code", boxtree.curve_code(xs, lo, hi))
    count = max(1, -(-uniq.count() // block))
    keys = ["part", "_code"]
    laid = coded.repartitionByRange(count, *keys, F.xxhash64(*xs)) if count > 1 else coded.coalesce(1)
    # Numbers are fixed by the written table.
    points = settle(
        laid.sortWithinPartitions(*keys).select(
            "part", F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().alias("_p"), *xs, "w", "id"
        )
    )
    boxes = settle(points.groupBy("part", "_b").agg(F.sum("w").alias("n"), *bounds))
    small = points.groupBy("part", "_b", F.shiftright("_p", SUB_BITS).alias("_s")).agg(*bounds)
    subs = settle(small.groupBy("part", "_b").agg(F.flatten(F.collect_list(F.array(*lo, *hi))).alias("_subs")))
    many = settle(points.where("w > 1").select("part", "_p", *xs))
    copies = None if many.isEmpty() else settle(good.join(many, ["part", *xs]).select("part", "_p", "id"))
    twins = settle(points.groupBy("part", "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR id IS NULL").select("part", "id"))
    odd = None
    if not twins.isEmpty():
        t = twins.select(F.col("part").alias("_part"), F.col("id").alias("_id"))
        odd = settle(points.join(t, (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("part", "_p"))
    lost = rows.where(f"NOT ({whole})").select("part", "id")
    return Blocks(d, count, points, boxes, copies, lost, odd, subs)


def together(a: DataFrame, b: DataFrame, keys: list[str], tasks: int):
    """Both sides grouped by `keys` in `tasks` partitions: by bytes alone Spark would put many groups into one task."""
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys))


def box_gap(d: int, x: list[Column], y: list[Column], lo: list[str], hi: list[str]) -> Column:
    """Squared distance between a box (its corners `x` and `y`; a point is twice the same) and the box in the columns `lo` and `hi`."""
    total = F.lit(0.0)
    for i in range(d):
        gap = F.greatest(F.col(lo[i]) - y[i], x[i] - F.col(hi[i]), F.lit(0.0))
        total = total + gap * gap
    return total


class _Leaves:
    """The points of one block in curve order, with a box per `LEAF` of them."""

    def __init__(self, x: np.ndarray):
        self.x, self.cuts = x, np.arange(0, len(x), LEAF)
        self.lo, self.hi = np.minimum.reduceat(x, self.cuts), np.maximum.reduceat(x, self.cuts)

    def near(self, q: np.ndarray, most: float) -> np.ndarray:
        """Numbers of the points that can be within `most` (squared) of one of `q`."""
        leaves = np.flatnonzero(_gap(q.min(axis=0), q.max(axis=0), self.lo, self.hi) <= most * SLACK)
        found = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        found = found[found < len(self.x)]
        at = self.x[found]
        return found[_gap(q.min(axis=0), q.max(axis=0), at, at) <= most * SLACK]


def _gap(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(los - hi, lo - his), 0.0)
    return (gap * gap).sum(axis=-1)


def _apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, summed in feature order."""
    total = np.zeros((len(q), len(x)))
    for f in range(x.shape[1]):
        diff = q[:, f, None] - x[None, :, f]
        total += diff * diff
    return total


def _nearest(q: np.ndarray, x: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of `q`: the (at most k) smallest squared distances to `x`, their weights, and the one that reaches weight k."""
    d2 = _apart(q, x)
    if len(x) > k:
        at = np.argpartition(d2, k - 1, axis=1)[:, :k]
        d2, w = np.take_along_axis(d2, at, axis=1), w[at]
    else:
        w = np.broadcast_to(w, d2.shape)
    order = np.argsort(d2, axis=1)
    d2, w = np.take_along_axis(d2, order, axis=1), np.take_along_axis(w, order, axis=1)
    enough = np.cumsum(w, axis=1) >= k
    kth = np.where(enough.any(axis=1), np.take_along_axis(d2, enough.argmax(axis=1)[:, None], axis=1)[:, 0], np.inf)
    return d2, w, kth


def _bound(q: np.ndarray, x: np.ndarray, w: np.ndarray, k: int) -> float:
    """Squared distance within which all of `q` have weight k in `x`."""
    if len(x) < k or w.max() > 1:
        return _nearest(q, x, w, k)[2].max()
    return np.partition(_apart(q, x), k - 1, axis=1)[:, k - 1].max()


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[n].to_numpy() for n in names], axis=1) if table.num_rows else np.empty((0, len(names)))


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def k_distances(b: Blocks, k: int) -> DataFrame:
    """The points with `kd2`, the squared distance within which a point has `k` rows (itself counted); NULL in a part of fewer."""
    d, xs, lo, hi = b.d, axes(b.d), axes(b.d, "lo"), axes(b.d, "hi")
    # A k-th row lies within the block's own diagonal, if the block has k rows.
    i = b.boxes.select("part", F.col("_b").alias("_i"), F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in lo + hi])
    span = F.lit(0.0)
    for a, z in zip(lo, hi):
        span = span + (F.col(f"_{z}") - F.col(f"_{a}")) * (F.col(f"_{z}") - F.col(f"_{a}"))
    reach = box_gap(d, [F.col(f"_{c}") for c in lo], [F.col(f"_{c}") for c in hi], lo, hi)
    near = settle(
        i.join(b.boxes, "part").where((F.col("_i") != F.col("_b")) & ((F.col("_n") < k) | (reach <= span * SLACK)))
        .join(b.subs, ["part", "_b"]).select("part", F.col("_i").alias("_b"), F.col("_b").alias("_j"), "_subs")
    )

    part_type = b.points.schema["part"].dataType.simpleString()

    def own(points: pa.Table, boxes: pa.Table) -> pa.Table:
        points = points.take(pa.array(np.argsort(points["_p"].to_numpy())))
        x, w = _matrix(points, xs), points["w"].to_numpy()
        subs = boxes["_subs"].combine_chunks()
        corners = subs.flatten().to_numpy().reshape(-1, 2 * d)
        at, blo, bhi = np.repeat(boxes["_j"].to_numpy(), subs.value_lengths().to_numpy(zero_copy_only=False) // (2 * d)), corners[:, :d], corners[:, d:]
        leaves, n = _Leaves(x) if len(x) else None, len(x)
        kd2, to, to_n = np.empty(n), [], []
        step = max(LEAF, 2 * k)
        for s in range(0, n, LEAF):
            q = x[s : s + LEAF]
            around = slice(max(0, s - step), s + LEAF + step)
            most = _bound(q, x[around], w[around], k)
            c = leaves.near(q, most)
            kth = _nearest(q, x[c], w[c], k)[2]
            kd2[s : s + LEAF] = kth
            some = np.flatnonzero(_gap(q.min(axis=0), q.max(axis=0), blo, bhi) <= kth.max() * SLACK)
            meets = _gap(q[:, None], q[:, None], blo[None, some], bhi[None, some]) < kth[:, None] * SLACK
            first = np.flatnonzero(np.diff(at[some], prepend=-1))  # small boxes of a block lie together
            meets = np.logical_or.reduceat(meets, first, axis=1) if len(first) else meets
            to.append(np.broadcast_to(at[some][first], meets.shape)[meets])
            to_n.append(meets.sum(axis=1))
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return (
            points.append_column("kd2", pa.array(kd2, pa.float64()))
            .append_column("_t", _lists(cat(to_n), cat(to), pa.int32()))
            .select([*points.column_names, "kd2", "_t"])
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.points.schema)
    first = settle(
        together(b.points, near, ["part", "_b"], b.count).applyInArrow(own, f"{schema}, kd2 double, _t array<int>")
    )

    def other(queries: pa.Table, points: pa.Table) -> pa.Table:
        keys, counts, dist, weight = [], [], [], []
        if queries.num_rows and points.num_rows:
            queries = queries.take(pa.array(np.argsort(queries["_p"].to_numpy())))
            points = points.take(pa.array(np.argsort(points["_p"].to_numpy())))
            x, w, q, most = _matrix(points, xs), points["w"].to_numpy(), _matrix(queries, xs), queries["kd2"].to_numpy()
            leaves = _Leaves(x)
            for s in range(0, len(q), LEAF):
                e = slice(s, s + LEAF)
                c = leaves.near(q[e], most[e].max())
                if not len(c):
                    continue
                d2, ws, _ = _nearest(q[e], x[c], w[c], k)
                inside = d2 < most[e, None]
                has = inside.any(axis=1)
                keys.append(np.arange(s, s + len(has))[has])
                counts.append(inside.sum(axis=1)[has])
                dist.append(d2[inside])
                weight.append(ws[inside])
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        kept = queries.select(["part", "_h", "_p"]).take(pa.array(cat(keys), pa.int64()))
        return kept.append_column("_d", _lists(cat(counts), cat(dist), pa.float64())).append_column("_w", _lists(cat(counts), cat(weight), pa.int64()))

    def merge(points: pa.Table, lists: pa.Table) -> pa.Table:  # a list's point is always in the same group
        if not lists.num_rows:
            return points
        points = points.take(pa.array(np.argsort(points["_p"].to_numpy())))
        x, w, kd2, found = _matrix(points, xs), points["w"].to_numpy(), points["kd2"].to_numpy().copy(), lists["_d"].combine_chunks()
        # The own lists are found again, for these points only: to store and send them all would be most of the data.
        far = np.searchsorted(points["_p"].to_numpy(), lists["_p"].to_numpy())
        again, leaves = np.unique(far), _Leaves(x)
        key, dist = [np.repeat(far, found.value_lengths().to_numpy(zero_copy_only=False))], [found.flatten().to_numpy()]
        weight = [lists["_w"].combine_chunks().flatten().to_numpy()]
        for s in range(0, len(again), LEAF):
            own = again[s : s + LEAF]
            c = leaves.near(x[own], kd2[own].max())
            d2, ws, _ = _nearest(x[own], x[c], w[c], k)
            key.append(np.repeat(own, d2.shape[1]))
            dist.append(d2.ravel())
            weight.append(ws.ravel())
        key, dist, weight = (np.concatenate(v) for v in (key, dist, weight))
        order = np.lexsort((dist, key))
        key, dist, weight = key[order], dist[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.cumsum(weight)
        before = np.repeat(total[first] - weight[first], np.diff(np.append(first, len(key))))
        kd2[key[first]] = np.minimum.reduceat(np.where(total - before >= k, dist, np.inf), first)
        return points.drop_columns(["kd2"]).append_column("kd2", pa.array(kd2, pa.float64()))

    asked = first.select("part", F.col("_b").alias("_h"), F.explode("_t").alias("_b"), "_p", *xs, "kd2")
    far = together(asked, b.points, ["part", "_b"], b.count).applyInArrow(
        other, f"part {part_type}, _h int, _p bigint, _d array<double>, _w array<bigint>"
    )
    merged = together(first.drop("_t"), far.withColumnRenamed("_h", "_b"), ["part", "_b"], b.count).applyInArrow(merge, f"{schema}, kd2 double")
    return settle(merged.withColumn("kd2", _finite("kd2")))


def _finite(c: str) -> Column:
    return F.when(F.col(c) < float("inf"), F.col(c))


def kth(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per key the distance at which the weights of its lists (`_d`, `_w`) reach `k`, as `kd2`."""
    every = lists.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("_d", "_w")))).alias("_l"))
    kth = F.expr(
        f"aggregate(_l, struct(0L AS n, CAST(NULL AS double) AS d), (a, x) -> IF(a.n >= {k}, a, struct(a.n + x._w AS n, x._d AS d)), a -> IF(a.n >= {k}, a.d, NULL))"
    )
    return every.select(*by, kth.alias("kd2"))


def _routed(b: Blocks, queries: DataFrame, d2: str, keep: list[str]) -> DataFrame:
    """Each query (part, x0..) once per block whose box is within its squared distance `d2`; `_b` is that block."""
    x, lo, hi = [F.col(c) for c in axes(b.d)], axes(b.d, "lo"), axes(b.d, "hi")
    boxes = b.boxes.select("part", F.col("_b").alias("_j"), *lo, *hi)
    met = queries.join(boxes, "part").where(box_gap(b.d, x, x, lo, hi) <= F.col(d2) * SLACK)
    return met.select("part", F.col("_j").alias("_b"), *keep)


def k_lists(b: Blocks, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """All of the `k` nearest points' distances and weights of some points (part, key, x0.., _most), in one or more lists per key."""
    xs = axes(b.d)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*key).schema)

    def look(queries: pa.Table, points: pa.Table) -> pa.Table:
        names = [*key, "_d", "_w"]
        q, x, w = _matrix(queries, xs), _matrix(points, xs), points["w"].to_numpy()
        counts, dist, weight = [], [], []
        for s in range(0, len(q), LEAF if len(x) else len(q) + 1):
            d2, ws, _ = _nearest(q[s : s + LEAF], x, w, k)
            counts.append(np.full(len(d2), d2.shape[1]))
            dist.append(d2.ravel())
            weight.append(ws.ravel())
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        kept = queries.select(key) if len(x) else queries.select(key).slice(0, 0)
        return kept.append_column("_d", _lists(cat(counts), cat(dist), pa.float64())).append_column("_w", _lists(cat(counts), cat(weight), pa.int64())).select(names)

    asked = _routed(b, queries, "_most", [*key, *xs])
    return together(asked, b.points, ["part", "_b"], b.count).applyInArrow(look, f"{schema}, _d array<double>, _w array<bigint>")


def lowest_label(b: Blocks, runs: DataFrame, loose: DataFrame, labelled: DataFrame) -> DataFrame:
    """run, _p and the lowest `cluster` of the labelled points within eps, for the loose points (run, eps, _b, _p, x0..) that have one.

    `runs` has run, part, eps; `labelled` has run, _b, _p, x0.., cluster.
    """
    xs = axes(b.d)
    # First the blocks that the point's own block can meet, then those the point itself meets.
    lo, hi = axes(b.d, "lo"), axes(b.d, "hi")
    i = b.boxes.select("part", F.col("_b").alias("_i"), *[F.col(c).alias(f"_{c}") for c in lo + hi])
    gap = box_gap(b.d, [F.col(f"_{c}") for c in lo], [F.col(f"_{c}") for c in hi], lo, hi)
    e2 = F.col("eps") * F.col("eps")
    pairs = runs.join(i, "part").join(b.boxes.withColumnRenamed("_b", "_j"), "part").where(gap <= e2 * SLACK)
    pairs = settle(pairs.select("run", F.col("_i").alias("_b"), "_j", *lo, *hi))
    x = [F.col(c) for c in xs]
    met = loose.join(pairs, ["run", "_b"]).where(box_gap(b.d, x, x, lo, hi) <= e2 * SLACK)
    asked = settle(met.select("run", F.col("_j").alias("_b"), "_p", e2.alias("_e2"), *xs))
    wanted = settle(asked.select("run", "_b").distinct())
    held = labelled.join(wanted, ["run", "_b"], "left_semi").select("run", "_b", "_p", *xs, "cluster")

    def look(queries: pa.Table, points: pa.Table) -> pa.Table:
        runs, keys, least = [], [], []
        if queries.num_rows and points.num_rows:
            queries = queries.take(pa.array(np.argsort(queries["_p"].to_numpy())))
            points = points.take(pa.array(np.argsort(points["_p"].to_numpy())))
            x, q, label, p, e2 = _matrix(points, xs), _matrix(queries, xs), points["cluster"].to_numpy().astype(np.int64), queries["_p"].to_numpy(), queries["_e2"].to_numpy()
            leaves, none = _Leaves(x), np.iinfo(np.int32).max
            for s in range(0, len(q), LEAF):
                e = slice(s, s + LEAF)
                c = leaves.near(q[e], e2[e].max())
                if not len(c):
                    continue
                best = np.where(_apart(q[e], x[c]) <= e2[e, None], label[c][None], none).min(axis=1)
                has = best < none
                keys.append(p[e][has])
                least.append(best[has])
            runs = [queries["run"][0].as_py()] * sum(map(len, keys))
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return pa.Table.from_arrays([pa.array(runs, pa.string()), pa.array(cat(keys), pa.int64()), pa.array(cat(least), pa.int32())], names=["run", "_p", "cluster"])

    found = together(asked, held, ["run", "_b"], b.count).applyInArrow(look, "run string, _p bigint, cluster int")
    return found.groupBy("run", "_p").agg(F.min("cluster").alias("cluster"))
