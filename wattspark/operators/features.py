"""Short-memory features per device: rolling mean and step change.

A device's history is cut into fixed time pieces so that one busy device is spread over many
tasks. Each piece also receives the last `n - 1` readings before it (its halo), which makes the
result equal to one window over the whole history.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspark.operators.common import settle
from wattspark.schema import POWER

PIECE = "hour"


def with_halo(
    df: DataFrame, keys: list[str], halo: int, order: list[str], carry: list[str], piece: str = PIECE
) -> DataFrame:
    """Rows plus, for each (keys, piece), the last `halo` earlier rows marked `_halo`.

    Only `carry` and `order` columns of halo rows are filled.
    """
    cut_rows = df.withColumn("_piece", F.date_trunc(piece, order[0]).cast("timestamp_ntz"))
    fields = list(dict.fromkeys(order + carry))
    newest = Window.partitionBy(*keys, "_piece").orderBy(*[F.desc(c) for c in order])
    # Ranking with an upper bound keeps at most `halo` rows per piece before the shuffle.
    tails = (
        cut_rows.select(*keys, "_piece", *fields)
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= halo)
        .groupBy(*keys, "_piece")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_tail"))
    )
    # Every stored piece has at least one row, so the last `halo` pieces are enough. This window
    # sees one small row per piece, not the readings.
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(-halo, -1)
    halos = (
        tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(before)))
        .select(
            *keys,
            "_piece",
            F.explode(
                F.slice("_prev", F.greatest(F.lit(1), F.size("_prev") - halo + 1), F.lit(halo))
            ).alias("_r"),
        )
        .select(*keys, "_piece", *[F.col(f"_r.{c}").alias(c) for c in fields])
        .withColumn("_halo", F.lit(True))
    )
    return cut_rows.withColumn("_halo", F.lit(False)).unionByName(halos, allowMissingColumns=True)


def power_features(
    df: DataFrame,
    keys: list[str] | None = None,
    v: str = POWER,
    n: int = 5,
    order: list[str] | None = None,
    piece: str = PIECE,
) -> DataFrame:
    """Add `rolling_mean_power` (current and n-1 earlier readings) and `power_delta` (first = 0)."""
    keys = keys or ["gpu_id"]
    order = order or ["timestamp", "row_id"]
    w = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        with_halo(df, keys, n - 1, order, [v], piece)
        .withColumn("rolling_mean_power", F.avg(v).over(w.rowsBetween(-(n - 1), 0)))
        .withColumn("power_delta", F.coalesce(F.col(v) - F.lag(v).over(w), F.lit(0.0)))
        .where(~F.col("_halo"))
        .drop("_piece", "_halo")
    )


def rolling_mean(df: DataFrame, keys=None, v: str = POWER, n: int = 5, order=None) -> DataFrame:
    return power_features(df, keys, v, n, order).drop("power_delta")


def power_delta(df: DataFrame, keys=None, v: str = POWER, order=None) -> DataFrame:
    return power_features(df, keys, v, 2, order).drop("rolling_mean_power")


def label_encode(df: DataFrame, col: str = "pci_bus_id", within: list[str] | None = None) -> DataFrame:
    """Add `encoded_<col>`: position of the value among the sorted distinct values of its group.

    Only distinct values are ranked; rows take the code through a join. The values are sorted in ranges: a
    value's position in its range is added to the number of values in the ranges before it, so no task ranks
    all of them.
    """
    within = within or []
    place = F.monotonically_increasing_id()  # fixed by the written table: range number, position in it
    ranged = df.select(*within, col).distinct().repartitionByRange(*within, col).sortWithinPartitions(*within, col)
    placed = settle(ranged.withColumn("_place", place))
    part, position = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # Small tables: one row per range, and per range and group.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_part", part).join(starts, "_part").withColumn("_rank", F.col("_start") + position)
    if within:
        first = ranked.groupBy(*within).agg(F.min("_rank").alias("_first"))
        same = None
        for c in within:
            equal = F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
            same = equal if same is None else same & equal
        ranked = ranked.alias("_l").join(first.alias("_r"), same).select(*[F.col(f"_l.{c}").alias(c) for c in within], f"_l.{col}", (F.col("_rank") - F.col("_first")).alias("_rank"))
    codes = settle(ranked.select(*within, col, F.col("_rank").cast("int").alias(f"encoded_{col}")))
    return df.join(codes, [*within, col], "left")
