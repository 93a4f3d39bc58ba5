"""Fit quality and closed-form fits from mergeable sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators.quantiles import robust_sigma


def fit_statistics(rows: DataFrame, distance: str, keys: list[str], tolerance: float | None = None) -> DataFrame:
    """rms, largest distance, robust sigma, inlier share and count per fit.

    Inliers lie within `tolerance`, or within three sigmas when it is not given. A fit without a
    finite distance keeps its row, with no sigma.
    """
    d = F.col(distance)
    sigma = robust_sigma(rows, keys, distance)
    limit = F.lit(tolerance) if tolerance is not None else 3 * F.greatest("sigma", F.lit(1e-4))
    return (
        rows.join(sigma, keys, "left").groupBy(*keys).agg(
            F.count("*").alias("point_count"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"),
            F.max("sigma").alias("sigma"), F.avg((F.abs(d) <= limit).cast("double")).alias("inlier_ratio"),
        )
    )


# ---------------------------------------------------------------- closed-form fits from sums

_QUADRIC = ["xx", "xy", "yy", "x", "y", "one"]


def _quadric_terms() -> dict:
    x, y = F.col("x"), F.col("y")
    return {"xx": 0.5 * x * x, "xy": x * y, "yy": 0.5 * y * y, "x": x, "y": y, "one": F.lit(1.0)}


def quadric_sums() -> list:
    """Normal equations of z = a x²/2 + b x y + c y²/2 + d x + e y + f as 28 mergeable sums."""
    terms = _quadric_terms()
    sums = [F.sum(terms[p] * terms[q]).alias(f"s_{i}_{j}") for i, p in enumerate(_QUADRIC) for j, q in enumerate(_QUADRIC) if j >= i]
    rhs = [F.sum(terms[p] * F.col("z")).alias(f"t_{i}") for i, p in enumerate(_QUADRIC)]
    return [*sums, *rhs, F.sum(F.col("z") * F.col("z")).alias("t_zz"), F.count("*").alias("n")]


def _solve_quadrics(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        m = np.empty((len(batch), 6, 6))
        for i in range(6):
            for j in range(i, 6):
                m[:, i, j] = m[:, j, i] = batch[f"s_{i}_{j}"]
        b = batch[[f"t_{i}" for i in range(6)]].to_numpy()
        coef = np.linalg.solve(m + 1e-12 * np.eye(6), b[..., None])[..., 0]
        left = batch["t_zz"].to_numpy() - 2 * (coef * b).sum(1) + np.einsum("ki,kij,kj->k", coef, m, coef)
        out = batch[keys].copy()
        for k, name in enumerate("abcdef"):
            out[name] = coef[:, k]
        out["residual"] = np.sqrt(np.maximum(left, 0.0) / batch["n"].to_numpy())
        out["n"] = batch["n"]
        yield out


def quadric_fit(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients `a … f`, rms residual and count per row of `quadric_sums`."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys]
    schema = ", ".join([*fields, *[f"{c} double" for c in "abcdef"], "residual double", "n long"])
    return sums.mapInPandas(lambda it: _solve_quadrics(it, keys), schema)
