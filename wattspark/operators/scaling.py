"""Standard scores and reproducible samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row, settle

SCALED = "_z"


def scaled_names(cols: list[str]) -> list[str]:
    return [c + SCALED for c in cols]


def fit_scaler(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation per feature (one row, or one per group)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return settle(df.groupBy(*(keys or [])).agg(*aggs))


def standardize_apply(
    df: DataFrame, params: DataFrame, cols: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Add `<col>_z` using fitted parameters; a constant feature becomes 0."""
    joined = df.join(params, keys) if keys else attach_one_row(df, params)
    return joined.withColumns(
        {
            c + SCALED: F.when(
                F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
            ).otherwise(F.lit(0.0))
            for c in cols
        }
    ).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")])


def standardize(
    df: DataFrame, cols: list[str], keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scaled rows and the fitted parameters."""
    params = fit_scaler(df, cols, keys)
    return standardize_apply(df, params, cols, keys), params


def sample_n(df: DataFrame, id: str, n: int) -> DataFrame:
    """Exactly n rows (or all), in the order of a hash of the key: reproducible, no seed state.

    A prefix of the hash first thins the rows to slightly more than n, so that no task has to
    hold n candidates per input split. The thinned set is counted, and used only if it is enough.
    """
    digest = F.md5(F.col(id).cast("string"))
    total = df.count()
    if total <= n:
        return df
    share = min(1.0, n / total * 1.1 + 1000 / total)
    hashed = df.withColumn("_digest", digest)
    if share < 1.0:
        limit = format(int(share * 16**8), "08x")
        thin = hashed.where(F.substring("_digest", 1, 8) < limit)
        if thin.select(id).count() >= n:
            hashed = thin
    return hashed.orderBy("_digest", id).limit(n).drop("_digest")
