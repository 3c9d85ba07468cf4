"""Exact density clustering (DBSCAN) on a grid, parameter search, and nearest-label transfer.

Points with equal coordinates are collapsed to one weighted point. Cells have a diagonal just
below eps, so a cell with `min_pts` points is all core and is one cluster piece; only points of
sparse cells (fewer than `min_pts` each) are compared with their neighbourhood. Cells are linked
through bounding boxes that are refined only where a decision is open, so no group of points is
ever expanded into all its pairs. Several (subset, eps) runs go through one plan, keyed by `run`.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspark.operators import blocks, boxtree
from wattspark.operators.blocks import Blocks
from wattspark.operators.common import keep, settle, spread, sq_distance
from wattspark.operators.components import connected_components, merge_components, smallest_linked
from wattspark.operators.quantiles import quantiles

MIN_PTS = 20
MOST_RUNS = 100
SPLIT = 4  # children per axis when a box is refined; a power of two keeps cell indices exact
TILE_CELLS = 32_768  # of a cube of cells that one task links
HOME, EDGE, MARGIN, OPEN = range(4)
ID_BUCKET = 20  # component ids are ranked in buckets of 2**ID_BUCKET


def _cell_names(d: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _side(eps: Column, d: int) -> Column:
    # Slightly less than eps / sqrt(d): two points of one cell are always closer than eps.
    return eps / math.sqrt(d) * (1 - 1e-9)


def _cells(x: list[Column], side: Column) -> list[Column]:
    return [F.floor(c / side) for c in x]


def _offsets(reach: int, d: int, skip_self: bool, half: bool = False) -> Column:
    """Array of neighbour offsets as mixed-radix numbers (from a rule, for any dimension)."""
    base = 2 * reach + 1
    middle = (base**d - 1) // 2
    first = middle + 1 if half else 0
    numbers = F.sequence(F.lit(first), F.lit(base**d - 1))
    return F.filter(numbers, lambda o: o != middle) if skip_self and not half else numbers


def _shift(o: Column, axis: int, reach: int) -> Column:
    base = 2 * reach + 1
    return F.floor(o / base**axis).cast("long") % base - reach


def _neighbour_cells(cells: DataFrame, d: int, half: bool = False, prefix: str = "n") -> DataFrame:
    """Each cell once per neighbour position: the cell's columns plus the neighbour's index."""
    reach = math.ceil(math.sqrt(d))
    wide = spread(cells, 2_000).withColumn("_o", F.explode(_offsets(reach, d, True, half)))
    return wide.withColumns(
        {f"{prefix}{i}": F.col(f"c{i}") + _shift(F.col("_o"), i, reach) for i in range(d)}
    ).drop("_o")


def _boxes(points: DataFrame, keys: list[str], d: int, unique: bool) -> DataFrame:
    """Bounding box and one real point, that of the smallest id, per group of core points.

    With `unique` ids the point is found column by column, which Spark aggregates by hash; a struct it would sort for.
    """
    xs = [f"x{i}" for i in range(d)]
    aggs = []
    for x in xs:
        aggs += [F.min(x).alias(f"{x}_lo"), F.max(x).alias(f"{x}_hi")]
    if not unique:
        return points.groupBy(*keys).agg(*aggs, F.min(F.struct("id", *xs)).alias("rep"))
    first = [F.min("id").alias("_id"), *[F.min_by(x, "id").alias(f"_{x}") for x in xs]]
    rep = F.struct(F.col("_id").alias("id"), *[F.col(f"_{x}").alias(x) for x in xs])
    return points.groupBy(*keys).agg(*aggs, *first).withColumn("rep", rep).drop("_id", *[f"_{x}" for x in xs])


def _box_test(d: int) -> Column:
    """1 = some pair is within eps, 0 = no pair can be, NULL = not decided by the boxes."""

    def edges(side: str, i: int) -> tuple[Column, Column]:
        return F.col(f"{side}.x{i}_lo"), F.col(f"{side}.x{i}_hi")

    near = far = None
    for i in range(d):
        (alo, ahi), (blo, bhi) = edges("a", i), edges("b", i)
        gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0))
        span = F.greatest(bhi - alo, ahi - blo)
        near = gap * gap if near is None else near + gap * gap
        far = span * span if far is None else far + span * span
    rep = sq_distance(
        [F.col(f"a.rep.x{i}") for i in range(d)], [F.col(f"b.rep.x{i}") for i in range(d)]
    )
    eps2 = F.col("eps") * F.col("eps")
    return F.when(near > eps2, 0).when((rep <= eps2) | (far <= eps2), 1)


def _box(d: int) -> Column:
    cols = [f"x{i}_{e}" for i in range(d) for e in ("lo", "hi")]
    return F.struct(*cols, "rep")


def _tile_links(cells: DataFrame, d: int) -> DataFrame:
    """What the boxes of the cells decide, tile by tile: run, eps, u, v, kind.

    A tile is a cube of cells with a margin of the neighbours' reach, so a task holds a bounded number of cells and
    each pair of neighbours meets once. `HOME`, `EDGE` and `MARGIN` rows say that cell v is linked to u, the
    smallest of its component in the tile; `EDGE` and `MARGIN` cells also lie in other tiles. `OPEN` rows are
    pairs that the boxes leave open and no other links join.
    """
    reach = math.ceil(math.sqrt(d))
    wide = max(reach, int(TILE_CELLS ** (1 / d)))
    cs, ts = _cell_names(d), _cell_names(d, "t")
    corners = [f"x{i}_{e}" for e in ("lo", "hi") for i in range(d)]
    flat = cells.select("run", "eps", *cs, "node", *[F.col(f"box.{c}").alias(c) for c in corners], *[F.col(f"box.rep.x{i}").alias(f"r{i}") for i in range(d)])
    edge = F.lit(False)
    for c, t in zip(cs, ts):
        own = F.floor(F.col(c) / wide)
        at = F.col(c) - own * wide
        low, high = at < reach, at >= wide - reach
        flat = flat.withColumn(t, F.explode(F.filter(F.array(own, F.when(low, own - 1), F.when(high, own + 1)), lambda v: v.isNotNull())))
        edge = edge | low | high
    home = F.lit(True)
    for c, t in zip(cs, ts):
        home = home & (F.floor(F.col(c) / wide) == F.col(t))
    groups = max(1, -(-cells.count() // TILE_CELLS))
    tiles = flat.withColumns({"_home": home, "_edge": edge, "_g": F.pmod(F.xxhash64("run", *ts), F.lit(groups))})
    base = 2 * reach + 1
    numbers = range((base**d - 1) // 2 + 1, base**d)
    moves = np.array([[o // base**i % base - reach for i in range(d)] for o in numbers], dtype=np.int64)
    node_type = cells.schema["node"].dataType.simpleString()

    def links(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("node", "ascending")]))
        col = lambda c: table[c].to_numpy()
        n = table.num_rows
        run = table["run"].combine_chunks().dictionary_encode().indices.to_numpy()
        tile = np.stack([run, *[col(t) for t in ts]], axis=1).astype(np.int64)
        c, room = np.stack([col(x) for x in cs], axis=1).astype(np.int64), wide + 2 * reach
        radix = room ** np.arange(d, dtype=np.int64)
        number = np.unique(tile, axis=0, return_inverse=True)[1].reshape(-1) * room**d + (c - tile[:, 1:] * wide + reach) @ radix
        order = np.argsort(number, kind="stable")
        held, homes = number[order], np.flatnonzero(col("_home"))
        lo, hi, rep, e2 = (np.stack([col(x) for x in names], axis=1) for names in (corners[:d], corners[d:], [f"r{i}" for i in range(d)], ["eps"]))
        e2 = e2[:, 0] * e2[:, 0]
        near, open_ = [], []
        for move in moves:
            want = number[homes] + move @ radix
            at = np.minimum(np.searchsorted(held, want), n - 1)
            hit = held[at] == want
            a, b = homes[hit], order[at[hit]]
            gap, span, apart = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
            for i in range(d):
                g = np.maximum(np.maximum(lo[b, i] - hi[a, i], lo[a, i] - hi[b, i]), 0.0)
                s = np.maximum(hi[b, i] - lo[a, i], hi[a, i] - lo[b, i])
                r = rep[a, i] - rep[b, i]
                gap, span, apart = gap + g * g, span + s * s, apart + r * r
            yes = (gap <= e2[a]) & ((apart <= e2[a]) | (span <= e2[a]))
            near.append(np.stack([a[yes], b[yes]]))
            maybe = (gap <= e2[a]) & ~yes
            open_.append(np.stack([a[maybe], b[maybe]]))
        a, b = np.concatenate(near, axis=1)
        root = smallest_linked(n, a, b)
        u, v = np.concatenate(open_, axis=1)
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        kind = np.where(col("_home"), np.where(col("_edge"), EDGE, HOME), MARGIN)
        first, second = np.concatenate([root, u]), np.concatenate([np.arange(n), v])
        return pa.table(
            {
                "run": table["run"].take(pa.array(second)), "eps": table["eps"].take(pa.array(second)),
                "u": table["node"].take(pa.array(first)), "v": table["node"].take(pa.array(second)),
                "kind": pa.array(np.concatenate([kind, np.full(len(u), OPEN)]), pa.int32()),
            }
        )

    return settle(tiles.repartition(groups, "_g").groupBy("_g").applyInArrow(links, f"run string, eps double, u {node_type}, v {node_type}, kind int"))


def _link_cells(cells: DataFrame, core: DataFrame, d: int, unique: bool) -> DataFrame:
    """run, node (smallest core id of the cell), comp for all cells that hold core points.

    Unless ids are `unique`, cells with the same node are one node.
    """
    cs = _cell_names(d)
    cells = cells.where("node IS NOT NULL")
    tested = _tile_links(cells, d)
    # Only cells that lie in several tiles, or share their node, connect the tiles' components.
    edges = tested.where(F.col("kind").isin(*([EDGE, MARGIN] if unique else [HOME, EDGE, MARGIN]))).select("run", "u", "v")
    joined = connected_components(edges.select("run", F.col("u").alias("node")).distinct(), edges)
    labels = (
        tested.where(F.col("kind").isin(HOME, EDGE))
        .join(joined.select("run", F.col("node").alias("u"), "comp"), ["run", "u"], "left")
        .select("run", F.col("v").alias("node"), F.coalesce("comp", "u").alias("comp"))
    )
    labels = settle(labels)

    # Pairs the boxes left open matter only while their cells are in different components.
    opened = tested.where(F.col("kind") == OPEN).select("run", "eps", "u", "v")
    level = 0
    while True:
        if opened.isEmpty():
            return labels
        opened = _still_apart(opened, labels)
        if opened.isEmpty():
            return labels
        level += 1
        side = _side(F.col("eps"), d) / SPLIT**level
        wanted = (
            opened.select("run", F.col("u").alias("node"))
            .unionByName(opened.select("run", F.col("v").alias("node")))
            .distinct()
        )
        subs = [F.floor(F.col(f"x{i}") / side).alias(f"s{i}") for i in range(d)]
        asked = settle(cells.select("run", *cs, "node").join(wanted, ["run", "node"], "left_semi"))
        inside = core.join(asked, ["run", *cs]).select(
            "run", "node", "id", *[f"x{i}" for i in range(d)], *subs
        )
        sub = _cell_names(d, "s")
        boxes = settle(
            _boxes(inside, ["run", "node", *sub], d, unique).select("run", "node", *sub, _box(d).alias("box"))
        )

        def end(name: str, box: str, parent: str) -> DataFrame:
            up = [
                F.floor(F.col(s) / SPLIT).cast("long").alias(f"{parent}{i}")
                for i, s in enumerate(sub)
            ]
            now = [F.col(s).alias(f"{box}s{i}") for i, s in enumerate(sub)]
            return boxes.select(
                "run", F.col("node").alias(name), *(up if level > 1 else []), *now,
                F.col("box").alias(box),
            )

        on_a, on_b = ["run", "u"], ["run", "v"]
        if level > 1:
            on_a += _cell_names(d, "pa")
            on_b += _cell_names(d, "pb")
        tested = settle(
            opened.join(end("u", "a", "pa"), on_a)
            .join(end("v", "b", "pb"), on_b)
            .withColumn("_t", _box_test(d))
            .where("_t IS NULL OR _t = 1")
            .select(
                "run", "eps", "u", "v", "_t",
                *[F.col(f"as{i}").alias(f"pa{i}") for i in range(d)],
                *[F.col(f"bs{i}").alias(f"pb{i}") for i in range(d)],
            )
        )
        more = tested.where("_t = 1").select("run", "u", "v").distinct()
        if not more.isEmpty():
            labels = merge_components(labels, more)
        opened = tested.where("_t IS NULL").drop("_t")


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select("run", F.col("node").alias("u"), F.col("comp").alias("_cu"))
    b = labels.select("run", F.col("node").alias("v"), F.col("comp").alias("_cv"))
    return settle(
        pairs.join(a, ["run", "u"]).join(b, ["run", "v"]).where("_cu <> _cv").drop("_cu", "_cv")
    )


def _numbered(labels: DataFrame) -> DataFrame:
    """run, node, cluster: components numbered 0.. per run in order of their smallest core id.

    Ids are ranked inside buckets, and bucket totals are summed up, so no task sees all of them.
    """
    roots = labels.select("run", "comp").distinct().withColumn(
        "_k", F.floor(F.col("comp") / 2**ID_BUCKET)
    )
    totals = roots.groupBy("run", "_k").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("run").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("run", "_k").orderBy("comp"))
    numbers = (
        roots.withColumn("_r", rank)
        .join(totals, ["run", "_k"])
        .select("run", "comp", (F.col("_base") + F.col("_r") - 1).cast("int").alias("cluster"))
    )
    return labels.join(numbers, ["run", "comp"]).select("run", "node", "cluster")


def _placed(points: DataFrame, feats: list[str], id: str, part: Column) -> DataFrame:
    xs = _cell_names(len(feats), "x")
    return points.select(part.alias("part"), F.col(id).alias("id"), *[(F.col(f).cast("double") + F.lit(0.0)).alias(x) for f, x in zip(feats, xs)])


@dataclass
class Neighbours:
    """Blocks of points, and `kd2` of each: what every radius needs to know of them."""

    blocks: Blocks
    points: DataFrame


def neighbours(df: DataFrame, feats: list[str], id: str, k: int = MIN_PTS, part: Column | None = None, block: int = blocks.BLOCK) -> Neighbours:
    """The k-distances of all rows, once for all runs over them; each value of `part` is a subset of its own."""
    made = blocks.build(_placed(df, feats, id, F.lit("all") if part is None else part), len(feats), block)
    return Neighbours(made, blocks.k_distances(made, k))


def _odd_cores(state: DataFrame, odd: DataFrame, d: int, min_pts: int) -> DataFrame:
    """run, _p, _core of points whose id names several points: each takes the sum of their neighbours beyond the own cell."""
    cs, xs, ns = _cell_names(d), _cell_names(d, "x"), _cell_names(d, "n")
    cells = settle(state.groupBy("run", *cs).agg(F.sum("w").alias("cell_n")))
    mine = settle(state.join(odd, ["part", "_p"], "left_semi").join(cells, ["run", *cs]))
    # Sparse cells whose surroundings could still reach min_pts.
    sparse = settle(mine.where(F.col("cell_n") < min_pts).select("run", *cs, "cell_n").distinct())
    around = settle(
        _neighbour_cells(sparse, d).join(
            cells.select("run", *[F.col(c).alias(n) for c, n in zip(cs, ns)], F.col("cell_n").alias("nbr_n")), ["run", *ns]
        )
    )
    hopeful = around.groupBy("run", *cs, "cell_n").agg(F.sum("nbr_n").alias("_more")).where(F.col("_more") + F.col("cell_n") >= min_pts)
    asked = settle(around.select("run", *cs, *ns).join(hopeful.select("run", *cs), ["run", *cs], "left_semi"))
    query = spread(asked, 20_000).join(mine, ["run", *cs]).select("run", "eps", "id", *ns, *[F.col(x).alias(f"q{i}") for i, x in enumerate(xs)])
    others = state.select("run", *[F.col(c).alias(n) for c, n in zip(cs, ns)], *xs, "w")
    close = sq_distance([F.col(f"q{i}") for i in range(d)], [F.col(x) for x in xs]) <= F.col("eps") * F.col("eps")
    reached = query.join(others, ["run", *ns]).where(close).groupBy("run", "id").agg(F.sum("w").alias("_far_n"))
    enough = F.col("cell_n") + F.coalesce("_far_n", F.lit(0)) >= min_pts
    return settle(mine.join(reached, ["run", "id"], "left").select("run", "_p", enough.alias("_core")))


def _labels(near: Neighbours, runs: DataFrame, id: str, min_pts: int) -> DataFrame:
    """DBSCAN for every row of `runs` (run, part, eps) over the points of its part: run, eps, <id>, cluster.

    A point is core if its k-th row (k = `min_pts`) is within eps. Core points of a cell are linked with each
    other, cells by their boxes; the other points look for core points in the blocks that their ball meets.
    """
    made, d = near.blocks, near.blocks.d
    cs, xs = _cell_names(d), _cell_names(d, "x")
    state = near.points.join(runs, "part").withColumns(dict(zip(cs, _cells([F.col(x) for x in xs], _side(F.col("eps"), d)))))
    within = F.coalesce(F.col("kd2") <= F.col("eps") * F.col("eps"), F.lit(False))
    if made.odd is not None:
        state = state.join(_odd_cores(state, made.odd, d, min_pts), ["run", "_p"], "left")
        within = F.coalesce("_core", within)
        state = settle(state.withColumn("core", within).drop("_core"))
    else:
        state = state.withColumn("core", within)
    core, loose = state.where("core"), state.where("NOT core")
    cells = settle(
        _boxes(core, ["run", "eps", *cs], d, made.odd is None).select("run", "eps", *cs, F.col("rep.id").alias("node"), _box(d).alias("box"))
    )
    numbered = _numbered(_link_cells(cells, core, d, made.odd is None))
    cell_label = settle(cells.join(numbered, ["run", "node"]).select("run", *cs, "cluster"))
    inner = settle(core.join(cell_label, ["run", *cs], "left").select("run", "eps", "part", "_b", "_p", *xs, "w", "id", "cluster"))

    # Border points: not core, but near a core point.
    border = blocks.lowest_label(made, runs, loose, inner.where("cluster IS NOT NULL"))
    key = "_p"
    if made.odd is not None:
        key = "id"
        border = border.join(loose.select("run", "_p", "id"), ["run", "_p"]).groupBy("run", "id").agg(F.min("cluster").alias("cluster"))
    outer = loose.join(border, ["run", key], "left")
    own = ["run", "eps", "part", "_p", "w", "id", F.coalesce("cluster", F.lit(-1)).alias("cluster")]
    labelled = settle(inner.select(*own).unionByName(outer.select(*own)))
    out = labelled.where("w = 1").select("run", "eps", "id", "cluster")
    if made.copies is not None:
        out = out.unionByName(made.copies.join(labelled.where("w > 1").drop("id"), ["part", "_p"]).select("run", "eps", "id", "cluster"))
    lost = made.lost.join(runs, "part").select("run", "eps", "id", F.lit(-1).alias("cluster"))
    return out.unionByName(lost).select("run", "eps", F.col("id").alias(id), "cluster")


def dbscan_runs(
    points: DataFrame, feats: list[str], id: str, min_pts: int = MIN_PTS
) -> DataFrame:
    """DBSCAN for every `run`: columns run, eps, <id>, cluster (-1 = noise).

    `points` has run, eps, the id and the features. Neighbourhoods are inclusive and count the
    point itself; clusters are numbered by their smallest core id, and a border point belongs to
    the lowest-numbered cluster that reaches it.
    """
    runs = settle(points.select("run", F.col("run").alias("part"), F.col("eps").cast("double").alias("eps")).distinct())
    return _labels(neighbours(points, feats, id, min_pts, F.col("run")), runs, id, min_pts)


def _constant_runs(df: DataFrame, runs: dict[str, tuple[str, float]]) -> DataFrame:
    """run, part, eps of a handful of runs, sent to every task: a shuffle by `part` would put all points of a part into one."""
    made = df.sparkSession.createDataFrame([(r, p, float(e)) for r, (p, e) in runs.items()], "run string, part string, eps double")
    return F.broadcast(made)


def dbscan(df: DataFrame, feats: list[str], id: str, eps: float, min_pts: int = MIN_PTS) -> DataFrame:
    """Add `cluster` to the rows (-1 = noise)."""
    labels = _labels(neighbours(df, feats, id, min_pts), _constant_runs(df, {"all": ("all", eps)}), id, min_pts)
    return df.join(labels.select(id, "cluster"), id)


def dbscan_full(df: DataFrame, feats: list[str], id: str, eps: float, min_pts: int = MIN_PTS) -> DataFrame:
    """DBSCAN on every row, whatever their number: there is no sample."""
    return dbscan(df, feats, id, eps, min_pts)


def _row_distances(near: Neighbours, id: str, k: int) -> DataFrame:
    """part, <id>, k_dist of all rows whose part has `k`; NULL for a row without a whole position.

    An id of several rows has one, over the distances of all of them.
    """
    made, xs = near.blocks, _cell_names(near.blocks.d, "x")
    points = near.points
    out = points.where("w = 1").select("part", "_p", "id", "kd2")
    if made.copies is not None:
        out = out.unionByName(made.copies.join(points.where("w > 1").select("part", "_p", "kd2"), ["part", "_p"]))
    several = settle(out.groupBy("part", "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("part").alias("_part"), F.col("id").alias("_id")))
    if not several.isEmpty():
        same = (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id"))
        twice = settle(out.join(several, same, "left_semi").groupBy("part", "_p", "id").agg(F.count(F.lit(1)).alias("_m")))
        most = F.coalesce("kd2", F.lit(float("inf"))).alias("_most")
        lists = blocks.k_lists(made, points.join(twice.select("part", "_p").distinct(), ["part", "_p"], "left_semi").select("part", "_p", *xs, most), ["_p"], k)
        weights = twice.join(lists, "_p").withColumn("_w", F.transform("_w", lambda w: w * F.col("_m")))
        merged = blocks.kth(weights, ["part", "id"], k)
        out = out.join(several, same, "left_anti").select("part", "id", "kd2").unionByName(merged)
    sizes = made.boxes.select("part", "n").unionByName(made.lost.select("part", F.lit(1).cast("long").alias("n")))
    enough = sizes.groupBy("part").agg(F.sum("n").alias("_n")).where(F.col("_n") >= k)
    lost = made.lost.join(enough, "part", "left_semi").select("part", "id").distinct()
    out = out.where("kd2 IS NOT NULL").select("part", "id", "kd2").unionByName(lost.withColumn("kd2", F.lit(None).cast("double")))
    return out.select("part", F.col("id").alias(id), F.sqrt("kd2").alias("k_dist"))


def k_distance(df: DataFrame, feats: list[str], id: str, k: int = MIN_PTS, block: int = blocks.BLOCK) -> DataFrame:
    """Distance from each row to its k-th nearest row, the row itself counted as the first."""
    return settle(_row_distances(neighbours(df, feats, id, k, block=block), id, k).drop("part"))


def eps_from_kdist(kdist: DataFrame, q: float = 0.9, floor: float = 0.1) -> DataFrame:
    """The q-quantile of the k-distances; a value that is not positive becomes `floor`."""
    eps = quantiles(kdist, [], "k_dist", [q], ["eps"])
    return eps.select(F.when(F.col("eps") > 0, F.col("eps")).otherwise(F.lit(floor)).alias("eps"))


def run_scores(labels: DataFrame) -> DataFrame:
    """Per run: rows, clusters, noise share, inlier share and the grid score."""
    noise = F.col("cluster") == -1
    clusters = F.count_distinct(F.when(~noise, F.col("cluster")))
    out = labels.groupBy("run", "eps").agg(
        F.count(F.lit(1)).alias("n"),
        clusters.alias("n_clusters"),
        F.avg(noise.cast("double")).alias("noise_share"),
    )
    inliers = 1 - F.col("noise_share")
    score = F.when(F.col("n_clusters") > 1, inliers * (F.log("n_clusters") + 1)).otherwise(0.0)
    return out.withColumn("inlier_ratio", inliers).withColumn("score", score)


def eps_grid_labels(df: DataFrame, feats: list[str], id: str, candidates: list[float], min_pts: int = MIN_PTS) -> DataFrame:
    """DBSCAN labels for all candidates from one plan; the k-distances are found once."""
    runs = _constant_runs(df, {str(e): ("all", e) for e in candidates})
    return _labels(neighbours(df, feats, id, min_pts), runs, id, min_pts)


def eps_grid_scores(df: DataFrame, feats: list[str], id: str, candidates: list[float], min_pts: int = MIN_PTS) -> DataFrame:
    return run_scores(eps_grid_labels(df, feats, id, candidates, min_pts)).select(
        "eps", "inlier_ratio", "n_clusters", "score"
    )


def eps_grid_select(scores: DataFrame) -> DataFrame:
    """The candidate with the highest score; equal scores go to the smallest eps."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("eps"), F.col("n_clusters")))
    return scores.agg(best.alias("b")).select(
        F.col("b.eps").alias("eps"),
        (-F.col("b.s")).alias("score"),
        F.col("b.n_clusters").alias("n_clusters"),
    )


def eps_autotune_runs(
    near: Neighbours, id: str, start: dict[str, float], tries: int = 5, min_pts: int = MIN_PTS
) -> tuple[dict[str, tuple[float, bool]], dict[str, DataFrame]]:
    """Tune eps for several runs side by side; each run is a part of `near`.

    A run is done when its noise is below one half and it has more than one cluster. Too much
    noise multiplies eps by 1.5, too few clusters by 0.8. `tries` is part of the method's definition:
    when all fail, the eps that would come next is used and marked as not converged. Gives (eps, converged) and the labels per run.
    """
    eps, done, labels = dict(start), {}, {}

    def cluster(names: list[str]) -> DataFrame:
        runs = _constant_runs(near.points, {r: (r, eps[r]) for r in names})
        return keep(_labels(near, runs, id, min_pts))

    for _ in range(tries):
        names = [r for r in eps if r not in done]
        if not names:
            break
        found = cluster(names)
        # One row per run (full, peak, non-peak) comes back to steer the next try.
        for row in run_scores(found).collect():
            if row.noise_share < 0.5 and row.n_clusters > 1:
                done[row.run] = (eps[row.run], True)
                labels[row.run] = found.where(F.col("run") == row.run)
            else:
                eps[row.run] *= 1.5 if row.noise_share >= 0.5 else 0.8
    names = [r for r in eps if r not in done]
    if names:
        found = cluster(names)
        for r in names:
            done[r] = (eps[r], False)
            labels[r] = found.where(F.col("run") == r)
    return done, labels


def eps_autotune(df: DataFrame, feats: list[str], id: str, eps0: float, tries: int = 5, min_pts: int = MIN_PTS) -> DataFrame:
    """One row: the chosen eps, whether it met the conditions, and what it gives."""
    done, labels = eps_autotune_runs(neighbours(df, feats, id, min_pts), id, {"all": eps0}, tries, min_pts)
    eps, converged = done["all"]
    return run_scores(labels["all"]).select(
        F.lit(eps).alias("eps"),
        F.lit(int(converged)).alias("converged"),
        "n_clusters",
        "noise_share",
    )


def nn_label_join(
    df: DataFrame, sample: DataFrame, feats: list[str], eps: float, id: str = "row_id"
) -> DataFrame:
    """Label of the nearest clustered row of `sample`, -1 when it is farther than eps.

    `sample` (id, features, cluster) may have any size. A row in a cell whose surroundings carry a single
    label takes it without any distance. The others descend a stored box tree of the clustered rows, in which
    equal positions are one point with the smallest id. Equally near rows: the smallest id.
    """
    d = len(feats)
    cs = _cell_names(d)
    e = F.lit(float(eps))
    xs = [f"x{i}" for i in range(d)]
    known = sample.where(F.col("cluster") != -1).select(F.col(id).alias("_key"), "cluster", *[F.col(f).alias(x) for f, x in zip(feats, xs)])
    known = known.groupBy(*xs).agg(F.min(F.struct("_key", "cluster")).alias("_first")).select(*xs, "_first.*")
    known = settle(known)

    # Fine cells: occupied ones where every label within reach is the same.
    fine = settle(
        known.select("cluster", *[c.alias(n) for c, n in zip(_cells([F.col(x) for x in xs], _side(e, d)), cs)]).distinct()
    )
    around = _neighbour_cells(fine, d, prefix="n")
    seen = around.select("cluster", *[F.col(f"n{i}").alias(c) for i, c in enumerate(cs)]).unionByName(fine)
    single = settle(
        seen.join(fine.select(*cs).distinct(), cs, "left_semi")
        .groupBy(*cs)
        .agg(F.min("cluster").alias("_only"), F.max("cluster").alias("_max"))
        .where("_only = _max")
        .drop("_max")
    )
    placed = df.withColumns(dict(zip(cs, _cells([F.col(c) for c in feats], _side(e, d))))).join(single, cs, "left").drop(*cs)
    tree = boxtree.build(known, d, ["_key", "cluster"])
    open_rows = placed.where("_only IS NULL")
    found = boxtree.nearest(tree, open_rows, id, feats, eps, ["_key", "cluster"])
    found = found.select(id, F.col("best.cluster").alias("_label"))
    return (
        placed.join(found, id, "left")
        .withColumn("cluster", F.coalesce("_only", "_label", F.lit(-1)))
        .drop("_only", "_label")
    )


def start_eps(near: Neighbours, id: str, part: str, min_pts: int = MIN_PTS) -> float:
    """The radius tuning of a part starts from; with fewer than `min_pts` rows, the floor of `eps_from_kdist`."""
    row = eps_from_kdist(settle(_row_distances(near, id, min_pts).where(F.col("part") == part))).first()
    return row["eps"] if row else 0.1


def dbscan_scalable(
    df: DataFrame, feats: list[str], id: str = "row_id", run: str | None = None, min_pts: int = MIN_PTS
) -> tuple[DataFrame, dict[str, tuple[float, bool]]]:
    """Tune the radius and cluster all rows; there is no sample, and one way for every size.

    With `run` (a column of few values, at most `MOST_RUNS`) the rows of each value are a separate run
    side by side. Returns the rows with `cluster`, and (eps, converged) per run. Fewer rows than
    `min_pts` are all noise.
    """
    rows = keep(df.withColumn("run", F.col(run).cast("string") if run else F.lit("all")))
    names = [r["run"] for r in rows.select("run").where("run IS NOT NULL").distinct().limit(MOST_RUNS + 1).collect()]
    if len(names) > MOST_RUNS:
        raise ValueError(f"{run} has more than {MOST_RUNS} values")
    near = neighbours(rows.where("run IS NOT NULL"), feats, id, min_pts, F.col("run"))
    start = {r: start_eps(near, id, r, min_pts) for r in names}
    chosen, labels = eps_autotune_runs(near, id, start, min_pts=min_pts)
    every = None
    for r in names:
        own = labels[r].select(id, "run", "cluster")
        every = own if every is None else every.unionByName(own)
    if every is None:
        return rows.withColumn("cluster", F.lit(None).cast("int")).drop("run"), chosen
    return rows.join(every, [id, "run"]).drop("run"), chosen


def dbscan_peak_nonpeak(df: DataFrame, feats: list[str], id: str = "row_id", **kw) -> tuple[DataFrame, dict]:
    """Peak and non-peak rows, each with its own eps (the scaler is shared)."""
    return dbscan_scalable(df, feats, id, run="is_peak", **kw)


def dbscan_grid(
    df: DataFrame, feats: list[str], candidates: list[float], id: str = "row_id", min_pts: int = MIN_PTS
) -> tuple[DataFrame, DataFrame]:
    """Grid form over all rows: the labels of the best candidate. (rows, scores)."""
    labels = keep(eps_grid_labels(df, feats, id, candidates, min_pts))
    scores = settle(run_scores(labels).select("eps", "inlier_ratio", "n_clusters", "score"))
    eps = eps_grid_select(scores).first()["eps"]
    return df.join(labels.where(F.col("eps") == eps).select(id, "cluster"), id), scores
