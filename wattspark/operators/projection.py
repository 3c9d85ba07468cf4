"""Two-dimensional principal-component projection."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _axes(df: DataFrame, feats: list[str]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Loadings (2 x d), explained shares and feature means.

    The d x d covariance comes from one aggregation over all rows; only that matrix is
    decomposed on the driver. The sign is fixed by a positive largest loading.
    """
    d = len(feats)
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)]
    for i in range(d):
        for j in range(i, d):
            aggs.append(F.covar_pop(feats[i], feats[j]).alias(f"c{i}_{j}"))
    row = df.agg(*aggs).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:2]
    axes = vectors[:, order].T
    for axis in axes:
        if axis[np.argmax(np.abs(axis))] < 0:
            axis *= -1
    return axes, values[order] / values.sum(), [row[f"m{i}"] for i in range(d)]


def _project(df: DataFrame, feats: list[str], axes: np.ndarray, means: list[float]) -> DataFrame:
    parts = {}
    for name, axis in zip(("pca1", "pca2"), axes):
        terms = [(F.col(f) - F.lit(m)) * F.lit(float(w)) for f, m, w in zip(feats, means, axis)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        parts[name] = total
    return df.withColumns(parts)


def pca_2d(df: DataFrame, feats: list[str]) -> DataFrame:
    """Add `pca1` and `pca2`, fitted on all rows."""
    axes, _, means = _axes(df, feats)
    return _project(df, feats, axes, means)


def pca_explained(df: DataFrame, feats: list[str]) -> DataFrame:
    """Share of the total variance on each of the two components."""
    _, shares, _ = _axes(df, feats)
    row = df.limit(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i + 1).alias("component"), F.lit(float(s)).alias("share"))
                    for i, s in enumerate(shares)
                ]
            )
        )
    )
    return row


def pca_by_peak(df: DataFrame, feats: list[str], refit: bool = False) -> DataFrame:
    """The projection with the peak flag kept; `refit` fits each side on its own rows."""
    if not refit:
        return pca_2d(df, feats)
    sides = [pca_2d(df.where(F.col("is_peak") == flag), feats) for flag in (1, 0)]
    return sides[0].unionByName(sides[1])

