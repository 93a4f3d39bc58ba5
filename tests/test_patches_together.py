"""Patches are solved together, and rounding is not taken for a gain."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanweave.plans import spline_patches as spp


def sums(rng, nu, nv, n=500):
    u, v, w = rng.uniform(0, nu, n), rng.uniform(0, nv, n), rng.normal(size=n)
    cu, cv = np.minimum(u.astype(int), nu - 1), np.minimum(v.astype(int), nv - 1)
    frame = pd.DataFrame({"cu": cu, "cv": cv, "ww": w * w})
    s, t = u - cu, v - cv
    for a in range(7):
        for b in range(7):
            frame[f"m{a}_{b}"] = s**a * t**b
            if max(a, b) < 4:
                frame[f"r{a}_{b}"] = w * s**a * t**b
    return frame.groupby(["cu", "cv"], as_index=False).sum()


def test_patches_of_mixed_spans_are_solved_together_across_batches():
    rng = np.random.default_rng(4)
    spans = [(2, 2), (5, 3), (2, 2), (9, 7), (5, 3), (2, 2)]
    cells = pd.concat([sums(rng, *s).assign(scan_id="a", label=k, nu=s[0], nv=s[1]) for k, s in enumerate(spans)], ignore_index=True)
    batches = (cells.iloc[k:k + 11] for k in range(0, len(cells), 11))
    found = pd.concat(spp._solved(batches, 0.1)).set_index("label")
    assert sorted(found.index) == list(range(len(spans)))
    for k, (nu, nv) in enumerate(spans):
        own = cells[cells["label"] == k]
        c, mse = spp.solve_patch(nu, nv, own["cu"].to_numpy(), own["cv"].to_numpy(), own[spp._MOMENTS].to_numpy(), own[spp._RIGHT].to_numpy(), own["ww"].sum(), 0.1)
        assert np.allclose(found.loc[k, "coefficients"], c.ravel(), atol=1e-10) and abs(found.loc[k, "mse"] - mse) < 1e-12


def test_an_exact_patch_is_not_refined(spark):
    i = np.arange(100)
    x, y = i % 10 - 4.5, i // 10 - 4.5
    frame = pd.DataFrame({"scan_id": "a", "label": 1, "point_id": i, "x": x, "y": y, "z": 0.01 * x * x - 0.02 * x * y + 0.1 * x, "nx": 0.0, "ny": 0.0, "nz": 1.0})
    points = spark.createDataFrame(frame).withColumn("label", F.col("label").cast("int"))
    patches, residuals = spp.fit_patches(points, smoothing=0.0)
    assert [(r.nu, r.nv) for r in patches.collect()] == [(2, 2)]
    left = residuals.toPandas()["residual"]
    assert len(left) == 100 and left.abs().max() < 1e-6
