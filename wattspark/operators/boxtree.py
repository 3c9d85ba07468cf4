"""A tree of bounding boxes over points, stored level by level, and nearest-point search by descent.

Points are laid along a space-filling curve and numbered; runs of `LEAF` numbers are leaves, and `FAN`
neighbouring nodes have one parent, so the levels are plain aggregates of the numbers' leading bits. All
levels are stored tables. A search starts with the at most `TOP` nodes of the highest level and goes down
one join per level: of a row's nodes those stay whose box can hold a nearer point than the bound, and the
bound shrinks with every level, as each box holds at least one point.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row, settle, sq_distance

LEAF_BITS, FAN_BITS = 5, 4
LEAF, FAN, TOP = 1 << LEAF_BITS, 1 << FAN_BITS, 64
PARTITION_BITS = 33  # of a number, below those of its partition
PART_ROWS = 8192
SLACK = 1 + 1e-9  # bounds are rounded, the final distances decide


def curve_code(x: list[str], lo: list[str], hi: list[str]) -> Column:
    """Position on a Z-curve of the coordinates `x` within the columns `lo` and `hi`, as a long."""
    bits = min(20, 60 // len(x))
    code = F.lit(0).cast("long")
    for i, c in enumerate(x):
        span = F.col(hi[i]) - F.col(lo[i])
        step = F.when(span > 0, F.floor((F.col(c) - F.col(lo[i])) / span * (2**bits - 1))).otherwise(F.lit(0)).cast("long")
        for bit in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)), bit * len(x) + i))
    return code


@dataclass
class BoxTree:
    d: int
    points: DataFrame  # leaf, x0.., and the payload
    levels: list[DataFrame]  # from the top: node, parent, l0.., h0..


def build(points: DataFrame, d: int, payload: list[str]) -> BoxTree:
    """The tree of `points` (columns x0.., payload); rows without a whole position are left out."""
    xs = [f"x{i}" for i in range(d)]
    good = points.where(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in xs)).select(*xs, *payload)
    ends = good.agg(*[F.min(x).alias(f"_l{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"_h{i}") for i, x in enumerate(xs)], F.count(F.lit(1)).alias("_n"))
    ends = settle(ends)
    parts = max(1, -(-ends.first()["_n"] // PART_ROWS))
    coded = attach_one_row(good, ends).withColumn("_code", curve_code(xs, [f"_l{i}" for i in range(d)], [f"_h{i}" for i in range(d)]))
    laid = coded.select(*xs, *payload, "_code").repartitionByRange(parts, "_code", F.xxhash64(*payload)).sortWithinPartitions("_code")
    # Numbers are fixed by the written table.
    leaf = F.shiftright(F.monotonically_increasing_id(), LEAF_BITS)
    stored = settle(laid.select(leaf.alias("leaf"), *xs, *payload))
    boxes = lambda lo, hi: [f(c(i)).alias(f"{n}{i}") for n, f, c in (("l", F.min, lo), ("h", F.max, hi)) for i in range(d)]
    level = stored.groupBy(F.col("leaf").alias("node")).agg(*boxes(lambda i: F.col(f"x{i}"), lambda i: F.col(f"x{i}")))
    levels, above = [], LEAF_BITS + FAN_BITS
    while True:
        # The second level still lies within a partition; from the third on nodes are partitions and their groups.
        up = FAN_BITS if above <= LEAF_BITS + FAN_BITS or above > PARTITION_BITS else PARTITION_BITS - above + FAN_BITS
        level = settle(level.withColumn("parent", F.shiftright("node", up)))
        levels.insert(0, level)
        if level.count() <= TOP:
            return BoxTree(d, stored, levels)
        level = level.groupBy(F.col("parent").alias("node")).agg(*boxes(lambda i: F.col(f"l{i}"), lambda i: F.col(f"h{i}")))
        above += up


def _gaps(q: list[str], d: int) -> tuple[Column, Column]:
    """Squared distance from a point to the nearest and to the farthest place of a box."""
    near = far = F.lit(0.0)
    for i in range(d):
        x, lo, hi = F.col(q[i]), F.col(f"l{i}"), F.col(f"h{i}")
        inner = F.greatest(lo - x, x - hi, F.lit(0.0))
        outer = F.greatest(x - lo, hi - x)
        near, far = near + inner * inner, far + outer * outer
    return near, far


def nearest(tree: BoxTree, rows: DataFrame, id: str, feats: list[str], radius: float, order: list[str]) -> DataFrame:
    """Of each row (`id` unique) with a point within `radius`: `id` and `best`, a struct of the squared
    distance and the columns `order` of its nearest point, the smallest of equally near ones."""
    d = tree.d
    q = [f"_q{i}" for i in range(d)]
    near, far = _gaps(q, d)
    limit = float(radius) * float(radius)
    found = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in feats)).select(F.col(id).alias("_id"), *[F.col(f"`{c}`").alias(x) for c, x in zip(feats, q)])
    found = found.withColumn("_bound", F.lit(limit * SLACK))
    own = Window.partitionBy("_id")
    for k, level in enumerate(tree.levels):
        if k == 0:
            met = found.join(F.broadcast(level), near <= F.col("_bound"))  # at most TOP nodes
        else:
            met = found.join(level, found["_node"] == level["parent"]).where(near <= F.col("_bound"))
        met = met.select("_id", *q, F.col("node").alias("_node"), near.alias("_near"), F.least("_bound", far * SLACK).alias("_bound"))
        met = met.withColumn("_bound", F.min("_bound").over(own)).where(F.col("_near") <= F.col("_bound"))
        found = met.drop("_near")
    points = found.join(tree.points, found["_node"] == tree.points["leaf"])
    apart = sq_distance([F.col(x) for x in q], [F.col(f"x{i}") for i in range(d)])
    return points.select("_id", F.struct(apart.alias("d2"), *order).alias("best")).where(F.col("best.d2") <= limit).groupBy(F.col("_id").alias(id)).agg(F.min("best").alias("best"))
