"""Exact grouped quantiles (linear interpolation) that never hold one group in one task.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer.
Here a bounded sketch first brackets each wanted rank, one counting pass then pre-aggregates
the rows (rows outside the brackets shrink to one count per gap), and a two-level prefix sum
finds the rank. A group holding most of the rows is split over tasks by value all the way.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row, settle, valid

SLICES = 256


def _on_keys(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(summary, keys) if keys else attach_one_row(df, summary)


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    qs: list[float],
    names: list[str],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: keys, `n` (valid rows) and the exact quantiles `qs` as `names`."""
    order = sorted(range(len(qs)), key=lambda i: qs[i])
    qs = [qs[i] for i in order]
    names = [names[i] for i in order]
    rows = df.where(valid(value)).select(*keys, F.col(value).cast("double").alias("_v"))

    # The sketch may miss a rank by n / accuracy; brackets leave four times that on both sides.
    slack = 4.0 / accuracy
    probs = [p for q in qs for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = settle(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_v", probs, accuracy).alias("_b"),
        )
    )

    # Slices of bracket i are numbered i*(SLICES+1)+1 ...; the gap below it is i*(SLICES+1).
    part, exact = [], []
    for i in range(len(qs)):
        base, lo, hi = i * (SLICES + 1), f"_b[{2 * i}]", f"_b[{2 * i + 1}]"
        share = f"CASE WHEN {hi} > {lo} THEN (_v - {lo}) / ({hi} - {lo}) ELSE 0D END"
        piece = f"{base + 1} + least({SLICES - 1}, cast(floor(({share}) * {SLICES}) AS int))"
        part.append(f"WHEN _v < {lo} THEN {base} WHEN _v <= {hi} THEN {piece}")
        exact.append(f"_v BETWEEN {lo} AND {hi}")
    top = len(qs) * (SLICES + 1)
    counted = (
        _on_keys(rows, sketch, keys)
        .selectExpr(
            *[f"`{k}`" for k in keys],
            "_n",
            "_v",
            f"CASE {' '.join(part)} ELSE {top} END AS _part",
            f"CASE WHEN {' OR '.join(exact)} THEN _v END AS _x",
        )
        .groupBy(*keys, "_part", "_x")
        .agg(
            F.expr("count(1) AS _c"),
            F.expr("min(_v) AS _mn"),
            F.expr("max(_v) AS _mx"),
            F.expr("max(_n) AS _n"),
        )
    )

    # Prefix sums: over the few parts of a group first, then only inside the parts that are hit.
    group = ", ".join([f"`{k}`" for k in keys]) or "1"
    parts = counted.groupBy(*keys, "_part").agg(
        F.expr("sum(_c) AS _pc"), F.expr("max(_n) AS _n")
    )
    parts = parts.selectExpr(
        "*",
        f"sum(_pc) OVER (PARTITION BY {group} ORDER BY _part"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto",
    )
    ranks = {}
    for i, q in enumerate(qs):
        ranks[f"_l{i}"] = f"floor({q!r}D * (_n - 1))"
        ranks[f"_h{i}"] = f"ceil({q!r}D * (_n - 1))"
    hit = " OR ".join(f"({w} >= _upto - _pc AND {w} < _upto)" for w in ranks.values())
    hits = parts.where(hit).selectExpr(
        *[f"`{k}`" for k in keys], "_part", "_upto - _pc AS _off"
    )
    inner = ", ".join([f"`{k}`" for k in keys] + ["_part"])
    found = counted.join(hits, [*keys, "_part"]).selectExpr(
        "*",
        f"_off + sum(_c) OVER (PARTITION BY {inner} ORDER BY _mn"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _end",
    )
    aggs = ["max(_n) AS n"]
    for name, w in ranks.items():
        aggs.append(
            f"max(CASE WHEN {w} >= _end - _c AND {w} < _end THEN"
            f" CASE WHEN _mn = _mx OR {w} = _end - _c THEN _mn"
            f" WHEN {w} = _end - 1 THEN _mx"
            " ELSE cast(raise_error('quantile rank outside its bracket') AS double) END"
            f" END) AS {name}"
        )
    out = found.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    return out.selectExpr(
        *[f"`{k}`" for k in keys],
        "n",
        *[
            f"_l{i} + (_h{i} - _l{i}) * ({q!r}D * (n - 1) - floor({q!r}D * (n - 1))) AS `{names[i]}`"
            for i, q in enumerate(qs)
        ],
    )


def quantile_row(df: DataFrame, value: str, qs: list[float], names: list[str]) -> DataFrame:
    """The exact quantiles of all rows as one settled row (NULL for an empty input)."""
    return settle(quantiles(df, [], value, qs, names).drop("n"))
