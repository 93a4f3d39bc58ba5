"""Refits under fixed values and relations, and snaps, against direct optimisation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanweave.plans import constrained as cn, fit_pipeline as fp, fits as ft


def frame(axis):
    axis = np.asarray(axis, float) / np.linalg.norm(axis)
    e = np.cross(axis, [1, 0, 0] if abs(axis[0]) < 0.9 else [0, 1, 0])
    e /= np.linalg.norm(e)
    return axis, e, np.cross(axis, e)


def cylinder(label, centre, axis, radius, n=1_500, noise=0.02, seed=0, sweep=2 * np.pi, length=20.0):
    rng = np.random.default_rng([seed, label])
    a, e, g = frame(axis)
    t, h = rng.uniform(0, sweep, n), rng.uniform(-length / 2, length / 2, n)
    out = np.cos(t)[:, None] * e + np.sin(t)[:, None] * g
    p = np.asarray(centre) + h[:, None] * a + (radius + rng.normal(0, noise, n))[:, None] * out
    return rows(label, p, out)


def plane(label, origin, normal, n=1_200, noise=0.02, seed=0, size=30.0):
    rng = np.random.default_rng([seed, label])
    a, e, g = frame(normal)
    st = rng.uniform(-size / 2, size / 2, (n, 2))
    p = np.asarray(origin) + st[:, :1] * e + st[:, 1:] * g + rng.normal(0, noise, (n, 1)) * a
    return rows(label, p, np.tile(a, (n, 1)))


def rows(label, p, n):
    out = pd.DataFrame(np.column_stack([p, n]), columns=["x", "y", "z", "nx", "ny", "nz"])
    return out.assign(scan_id="s", label=label, point_id=np.arange(len(p)))


def table(spark, *parts):
    return spark.createDataFrame(pd.concat(parts)).withColumn("label", F.col("label").cast("int")).repartition(4)


def kinds(spark, *pairs):
    return spark.createDataFrame([("s", label, kind) for label, kind in pairs], "scan_id string, label int, kind string")


def wanted(spark, *rows_):
    return cn.constraint_rows(spark, [dict(scan_id="s", **r) for r in rows_])


def test_fixed_values_and_ties_hold(spark):
    parts = [cylinder(1, (0, 0, 0), (0.02, 0.01, 1), 6.02), cylinder(2, (30, 0, 0), (0.0, 0.03, 1), 5.97), cylinder(3, (0, 40, 5), (1, 0.02, 0), 4.0),
             plane(4, (0, 0, 7.03), (0.01, 0, 1)), plane(5, (50, 0, 0), (1, 0.004, 0.002))]
    points = table(spark, *parts)
    every = kinds(spark, (1, "cylinder"), (2, "cylinder"), (3, "cylinder"), (4, "plane"), (5, "plane"))
    free = ft.fit_own(points, every)
    fixed = wanted(
        spark, {"label": 1, "kind": "cylinder", "tie": 9, "same_direction": True, "same_size": True}, {"label": 2, "kind": "cylinder", "tie": 9, "same_direction": True, "same_size": True},
        {"label": 3, "kind": "cylinder", "direction_x": -1.0, "direction_y": 0.0, "direction_z": 0.0, "fixed_radius": 4.0},
        {"label": 4, "kind": "plane", "perpendicular_x": 1.0, "perpendicular_y": 0.0, "perpendicular_z": 0.0, "fixed_offset": 7.0})
    got = {r["label"]: r for r in cn.refine_constrained(points, free, fixed).collect()}
    assert len(got) == 5 and all(r["settled"] for r in got.values())
    n = {k: np.array([r["nx"], r["ny"], r["nz"]]) for k, r in got.items()}
    o = {k: np.array([r["ox"], r["oy"], r["oz"]]) for k, r in got.items()}
    assert np.linalg.norm(np.cross(n[1], n[2])) < 1e-9 and abs(got[1]["radius"] - got[2]["radius"]) < 1e-9
    assert abs(got[1]["radius"] - 5.995) < 0.01
    assert abs(abs(n[3][0]) - 1) < 1e-12 and got[3]["radius"] == 4.0
    assert abs(n[4][0]) < 1e-12 and abs(o[4] @ n[4] - 7.0) < 1e-9
    assert abs(got[5]["rms"] - 0.02) < 0.003


def soft(residual, scale):
    return (np.sqrt(1 + (residual / scale) ** 2) - 1).sum()


def test_rms_is_that_of_the_constrained_optimum(spark):
    part = cylinder(1, (1, 2, 0), (0.03, -0.02, 1), 6.03, noise=0.03)
    points = table(spark, part)
    free = ft.fit_own(points, kinds(spark, (1, "cylinder")))
    got = cn.refine_constrained(points, free, wanted(spark, {"label": 1, "kind": "cylinder", "fixed_radius": 6.0, "perpendicular_x": 1.0, "perpendicular_y": 0.0, "perpendicular_z": 0.0})).first()
    p = part[["x", "y", "z"]].to_numpy()

    def residual(q):
        axis = np.array([0, np.sin(q[0]), np.cos(q[0])])
        d = p - np.array([q[1], q[2], 0])
        h = d @ axis
        return np.sqrt(np.maximum((d * d).sum(1) - h * h, 0)) - 6.0

    # A plain descent over the three numbers that are left.
    start = ft.fit_own(points, kinds(spark, (1, "cylinder"))).first()
    scale = max(1.4826 * np.median(np.abs(residual([0, 1, 2]) - np.median(residual([0, 1, 2])))), 1e-3)
    q = np.array([np.arctan2(got["ny"] * np.sign(got["nz"]), abs(got["nz"])), 1.0, 2.0])
    for _ in range(200):
        r = residual(q)
        j = np.column_stack([(residual(q + d) - residual(q - d)) / 2e-6 for d in np.eye(3) * 1e-6])
        w = 1 / np.sqrt(1 + (r / scale) ** 2)
        q = q - np.linalg.solve(j.T @ (w[:, None] * j), j.T @ (w * r))
    assert got["rms"] == pytest.approx(np.sqrt((residual(q) ** 2).mean()), rel=2e-3)
    assert start["rms"] <= got["rms"] * (1 + 1e-9)
    axis = np.array([got["nx"], got["ny"], got["nz"]])
    assert abs(axis[0]) < 1e-12
    assert abs(np.arctan2(axis[1] * np.sign(axis[2]), abs(axis[2])) - q[0]) < 1e-4


def test_uncertainties_cover_the_truth(spark):
    points = table(spark, *[cylinder(k, (0, 0, 0), (0, 0, 1), 8.0, n=400, seed=k) for k in range(1, 31)])
    free = ft.fit_own(points, kinds(spark, *[(k, "cylinder") for k in range(1, 31)]))
    error = fp.uncertainties(points, free, cn.constraint_rows(spark, []))
    rows_ = error.join(free.select("label", "radius"), "label").collect()
    z = np.array([(r["radius"] - 8.0) / r["size"] for r in rows_])
    assert 0.6 < z.std() < 1.5 and np.abs(z).max() < 4
