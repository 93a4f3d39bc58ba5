"""Fits in clutter, grown regions and spline patches against the shapes they were made from."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanweave.plans import fits as ft, robust, spline_patches as spp
from scanweave.plans.grow import grow_primitives, simplest_fits
from test_constrained import cylinder, kinds, plane, table


def angle_deg(a, b):
    return np.degrees(np.arccos(min(1.0, abs(float(np.dot(a, b))) / np.linalg.norm(a) / np.linalg.norm(b))))


def clutter(label, wanted, seed):
    """55 % of the wanted surface, 35 % a wall through its middle, 10 % junk."""
    rng = np.random.default_rng([seed, label])
    centre, n = wanted[["x", "y", "z"]].mean().to_numpy(), len(wanted)
    wall = plane(label, centre, rng.normal(size=3), n=int(n * 0.35 / 0.55), seed=seed + 5, size=40.0)
    junk_n = int(n * 0.10 / 0.55)
    junk = wall.head(0).reindex(range(junk_n)).assign(scan_id="s", label=label)
    junk[["x", "y", "z"]] = centre + rng.uniform(-20, 20, (junk_n, 3))
    normals = rng.normal(size=(junk_n, 3))
    junk[["nx", "ny", "nz"]] = normals / np.linalg.norm(normals, axis=1, keepdims=True)
    out = pd.concat([wanted, wall, junk], ignore_index=True)
    return out.assign(point_id=np.arange(len(out)))


@pytest.fixture(scope="module")
def messy(spark):
    tube = cylinder(1, (5, 3, 1), (0.3, 0.2, 1), 12.5, n=3_000, noise=0.03, sweep=2.1, length=30.0)
    flat = plane(2, (1, 2, 3), (0.2, -0.5, 1), n=3_000, noise=0.03, size=40.0)
    return pd.concat([clutter(1, tube, 1), clutter(2, flat, 2)])


def test_cylinder_and_plane_in_clutter(spark, messy):
    asked = kinds(spark, (1, "cylinder"), (2, "plane"))
    points = table(spark, messy)
    got = {r["label"]: r for r in robust.fit_robust(points, asked, 0.09).collect()}
    one, two = got[1], got[2]
    assert angle_deg([one["nx"], one["ny"], one["nz"]], [0.3, 0.2, 1]) < 0.05
    assert abs(one["radius"] - 12.5) < 0.01
    assert angle_deg([two["nx"], two["ny"], two["nz"]], [0.2, -0.5, 1]) < 0.05
    assert all(0.5 < r["share"] < 0.62 and r["settled"] and r["hypotheses"] == robust.BATCH for r in got.values())


def test_samples_do_not_depend_on_partitions(spark, messy):
    points = table(spark, messy)
    draws = []
    for df in (points, points.repartition(7, "x")):
        pool = ft.sample(df, ft.KEY, 500, "point_id").join(kinds(spark, (1, "cylinder"), (2, "plane")), ft.KEY)
        draws.append(sorted(map(tuple, pool.groupBy(*ft.FIT).applyInPandas(robust._drawn(0, 0), robust.HYPOTHESIS).collect())))
    assert draws[0] == draws[1] and len(draws[0]) > robust.BATCH


def test_minimal_samples_meet_exact_surfaces():
    rng = np.random.default_rng(4)

    def sample(p, n, need):
        pick = np.stack([rng.choice(len(p), need, replace=False) for _ in range(40)])
        return p[pick], n[pick]

    tube = cylinder(1, (1, 2, 3), (0.2, 0.1, 1), 7.0, noise=0.0)
    p, n = tube[["x", "y", "z"]].to_numpy(), tube[["nx", "ny", "nz"]].to_numpy()
    found = robust.minimal("cylinder", *sample(p, n, 2))
    found = found[np.isfinite(found).all(axis=1)]
    assert len(found) > 20 and np.allclose(found[:, 6], 7.0)
    assert all(robust.agreement("cylinder", f[:3], f[3:6], *f[6:], p, n, 1e-6, 0.9).all() for f in found)
    u = rng.normal(size=(500, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = robust.minimal("sphere", *sample(np.array([1, 2, 3]) + 4 * u, u, 2))
    assert np.allclose(found[np.isfinite(found).all(axis=1)][:, [0, 1, 2, 6]], [1, 2, 3, 4])
    t, h, half = rng.uniform(0, 2 * np.pi, 500), rng.uniform(2, 8, 500), 0.4
    p = np.column_stack([h * np.tan(half) * np.cos(t), h * np.tan(half) * np.sin(t), h])
    n = np.column_stack([np.cos(half) * np.cos(t), np.cos(half) * np.sin(t), np.full(500, -np.sin(half))])
    found = robust.minimal("cone", *sample(p, n, 3))
    found = found[np.isfinite(found).all(axis=1)]
    assert len(found) > 20 and np.allclose(found[:, 8], half, atol=1e-6) and np.allclose(found[:, :3], 0, atol=1e-6)
    s = rng.uniform(0, 2 * np.pi, 500)
    n = np.column_stack([np.cos(s) * np.cos(t), np.cos(s) * np.sin(t), np.sin(s)])
    p = 9 * np.column_stack([np.cos(t), np.sin(t), 0 * t]) + 2 * n
    found = robust.minimal("torus", *sample(p, n, 12))
    assert np.allclose(found[:, [6, 7]], [9, 2], atol=1e-6)


def test_all_kinds_of_a_plane_are_told(spark):
    rng = np.random.default_rng(5)
    part = plane(1, (0, 0, 0), (0, 0, 1), n=300, noise=0.01, size=10.0)
    part["z"] = rng.normal(scale=0.01, size=300)
    every = ft.fit_kinds(table(spark, part)).collect()
    told = {r["kind"] for r in every}
    assert {"plane", "sphere", "cylinder", "torus"} <= told
    best = ft.fit_best(table(spark, part), 0.012).first()
    assert best["kind"] == "plane" and best["settled"]


# ---------------------------------------------------------------- growth


def sheet(spark):
    """Flat, round edge of radius 6, upright wall, extruded along y: 1 mm faces."""
    arc = np.linspace(0, np.pi / 2, 11)[1:-1]
    profile = ([(x, 0.0) for x in np.arange(-20, 0.01, 1.0)] + [(6 * np.sin(a), 6 * np.cos(a) - 6) for a in arc] + [(6.0, z) for z in np.arange(-6, -26.01, -1.0)])
    m, depth = len(profile), 24
    rng = np.random.default_rng(7)
    xyz = np.array([(x, float(j), z) for j in range(depth) for x, z in profile]) + rng.normal(0, 0.005, (m * depth, 3))
    faces = []
    for j in range(depth - 1):
        for i in range(m - 1):
            k = j * m + i
            faces += [(k, k + 1, k + 1 + m), (k, k + 1 + m, k + m)]
    vertices = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(xyz)], "scan_id string, vertex_id long, x double, y double, z double")
    table_ = spark.createDataFrame([("s", k, *f, k % 50 == 49) for k, f in enumerate(faces)], "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean")
    part = np.array([(k // 2) % (m - 1) for k in range(len(faces))])
    truth = np.where(part < 20, 0, np.where(part < 30, 1, 2))
    return vertices, table_, truth, m


def test_growth_finds_plane_and_wall(spark):
    vertices, faces, truth, m = sheet(spark)
    row = 2 * (m - 1) * 11
    seeds = spark.createDataFrame([("s", 1, row + 20, None), ("s", 3, row + 80, "plane"), ("s", 4, 49, None)],
                                  "scan_id string, label int, face_id long, kind string")
    grown = grow_primitives(vertices, faces, seeds, 0.05, 0.01, 10.0)
    regions = grown.faces.toPandas()
    fits = {r["label"]: r for r in grown.fits.collect()}
    assert set(fits) == {1, 3} and not (regions["face_id"] % 50 == 49).any()
    usable = np.arange(len(truth)) % 50 != 49
    for label, part, kind in ((1, 0, "plane"), (3, 2, "plane")):
        mine = np.zeros(len(truth), dtype=bool)
        mine[regions.loc[regions["label"] == label, "face_id"]] = True
        want = (truth == part) & usable
        assert fits[label]["kind"] == kind
        assert (mine & want).sum() / (mine | want).sum() >= 0.8, label


def test_simplest_kind(spark):
    # Noisy planes and cylinders also fit as huge spheres and tori.
    points = table(spark, plane(1, (0, 0, 0), (0, 0, 1), n=800), cylinder(2, (0, 0, 0), (0, 0, 1), 5.0, n=1_500))
    rich = kinds(spark, (1, "sphere"), (2, "torus"))
    assert {r["label"]: r["kind"] for r in simplest_fits(points, chosen=rich).collect()} == {1: "plane", 2: "cylinder"}


# ---------------------------------------------------------------- spline patches


def hills(spark, n=4_000, noise=0.01):
    rng = np.random.default_rng(8)
    s, t = rng.uniform(-20, 20, n), rng.uniform(-12, 12, n)
    h = 1.5 * np.sin(s / 6) * np.cos(t / 7)
    hs, ht = 1.5 / 6 * np.cos(s / 6) * np.cos(t / 7), -1.5 / 7 * np.sin(s / 6) * np.sin(t / 7)
    normal = np.column_stack([-hs, -ht, np.ones(n)]) / np.sqrt(1 + hs**2 + ht**2)[:, None]
    p = np.column_stack([s, t, h]) + rng.normal(0, noise, (n, 1)) * normal
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    out = pd.DataFrame(np.column_stack([p @ turn.T + [3, 4, 5], normal @ turn.T]), columns=["x", "y", "z", "nx", "ny", "nz"])
    return out.assign(scan_id="s", label=1, point_id=np.arange(n))


def test_patch_follows_a_known_height_field(spark):
    ball = cylinder(2, (0, 0, 0), (0, 0, 1), 5.0, n=500)
    few = plane(3, (0, 0, 0), (0, 0, 1), n=10)
    patches, residuals = spp.fit_patches(table(spark, hills(spark), ball, few), smoothing=1e-3)
    told = {r["label"]: r for r in patches.collect()}
    assert told[2]["state"] == "too_curved" and told[3]["state"] == "too_few" and told[2]["coefficients"] is None
    one = told[1]
    assert one["state"] == "fitted" and 0.008 < one["rms"] < 0.0125 and one["max_abs"] < 0.08
    assert len(one["coefficients"]) == (one["nu"] + 3) * (one["nv"] + 3)
    r = residuals.toPandas()
    assert set(r["label"]) == {1} and len(r) == 4_000
    assert np.sqrt((r["residual"] ** 2).mean()) == pytest.approx(one["rms"], rel=1e-9)


def test_patch_solve_equals_dense_least_squares():
    rng = np.random.default_rng(9)
    nu, nv, n, smoothing = 5, 3, 400, 0.2
    au, av, w = rng.uniform(0, nu, n), rng.uniform(0, nv, n), rng.normal(size=n)
    cu, cv = np.minimum(au.astype(int), nu - 1), np.minimum(av.astype(int), nv - 1)
    pu, pv = spp.basis_pieces(nu), spp.basis_pieces(nv)
    assert np.allclose(pu.sum(axis=1), [[1, 0, 0, 0]] * nu)
    design = np.zeros((n, nu + 3, nv + 3))
    for k in range(n):
        bu, bv = pu[cu[k]] @ (au[k] - cu[k]) ** np.arange(4), pv[cv[k]] @ (av[k] - cv[k]) ** np.arange(4)
        design[k, cu[k]:cu[k] + 4, cv[k]:cv[k] + 4] = np.outer(bu, bv)
    a = design.reshape(n, -1)
    du, dv = np.diff(np.eye(nu + 3), 2, axis=0), np.diff(np.eye(nv + 3), 2, axis=0)
    bend = np.kron(du.T @ du, np.eye(nv + 3)) + np.kron(np.eye(nu + 3), dv.T @ dv)
    want = np.linalg.solve(a.T @ a + bend * smoothing * n / ((nu + 3) * (nv + 3)), a.T @ w)
    cells = sorted(set(zip(cu, cv)))
    moments, right = [], []
    for i, j in cells:
        at = (cu == i) & (cv == j)
        s, t = au[at] - i, av[at] - j
        moments.append([[(s**p * t**q).sum() for q in range(7)] for p in range(7)])
        right.append([[(w[at] * s**p * t**q).sum() for q in range(4)] for p in range(4)])
    got, mse = spp.solve_patch(nu, nv, *np.array(cells).T, np.array(moments).reshape(len(cells), -1), np.array(right).reshape(len(cells), -1), (w * w).sum(), smoothing)
    assert np.allclose(got.ravel(), want, atol=1e-8)
    assert mse == pytest.approx(((w - a @ want) ** 2).mean(), rel=1e-6)
