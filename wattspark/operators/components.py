"""Connected components of a graph held as DataFrames."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.common import settle

JUMPS = 3


def connected_components(nodes: DataFrame, edges: DataFrame, run: str = "run") -> DataFrame:
    """Columns run, node, comp, where comp is the smallest node id reachable from node.

    Every round each vertex points to its smallest neighbour, pointers are shortened a few times,
    and the graph is contracted along them, so its size falls geometrically. The two tables of a
    round are written, so lineage does not grow and Spark joins them by their real size.
    """
    graph = settle(edges.select(run, "u", "v").where("u <> v").distinct())
    pointers = []
    while not graph.isEmpty():
        both = graph.unionByName(graph.select(run, F.col("v").alias("u"), F.col("u").alias("v")))
        # The aggregate is shuffled once; the jumps reuse that exchange within one job.
        first = both.groupBy(run, "u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        nxt = first.select(run, F.col("u").alias("p"), F.col("p").alias("_pp"))
        up = first
        for _ in range(JUMPS):
            up = up.join(nxt, [run, "p"]).select(run, "u", F.col("_pp").alias("p"))
        up = settle(up)
        pointers.append(up)
        a = up.select(run, "u", F.col("p").alias("_a"))
        b = up.select(run, F.col("u").alias("v"), F.col("p").alias("_b"))
        graph = settle(
            graph.join(a, [run, "u"])
            .join(b, [run, "v"])
            .where("_a <> _b")
            .select(run, F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
            .distinct()
        )
    labels = nodes.select(run, "node", F.col("node").alias("comp"))
    for up in pointers:
        step = up.select(run, F.col("u").alias("comp"), F.col("p").alias("_p"))
        labels = labels.join(step, [run, "comp"], "left").select(
            run, "node", F.coalesce("_p", "comp").alias("comp")
        )
    return settle(labels)


def merge_components(labels: DataFrame, more: DataFrame, run: str = "run") -> DataFrame:
    """Labels after adding edges: only the components that the new edges touch are worked on."""
    a = labels.select(run, F.col("node").alias("u"), F.col("comp").alias("_a"))
    b = labels.select(run, F.col("node").alias("v"), F.col("comp").alias("_b"))
    edges = settle(
        more.join(a, [run, "u"])
        .join(b, [run, "v"])
        .select(run, F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
        .distinct()
    )
    touched = edges.select(run, F.col("u").alias("node")).unionByName(
        edges.select(run, F.col("v").alias("node"))
    )
    joined = connected_components(touched.distinct(), edges, run)
    step = joined.select(run, F.col("node").alias("comp"), F.col("comp").alias("_p"))
    return settle(
        labels.join(step, [run, "comp"], "left").select(
            run, "node", F.coalesce("_p", "comp").alias("comp")
        )
    )


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of the numbers below `n` the smallest that the links between `a` and `b` lead to (within one task)."""
    at = np.arange(n)
    while True:
        pa, pb = at[a], at[b]
        apart = pa != pb
        if not apart.any():
            return at
        a, b, pa, pb = a[apart], b[apart], pa[apart], pb[apart]
        np.minimum.at(at, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            further = at[at]
            if (further == at).all():
                break
            at = further
