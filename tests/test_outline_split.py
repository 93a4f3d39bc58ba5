"""Lines and arcs of sampled outlines against known shapes and a plain dynamic programme."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanweave.plans import outline_split as osp


def line(a, b, step):
    n = max(2, round(math.dist(a, b) / step))
    return [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(n)]


def arc(c, r, start, stop, step):
    n = max(2, round(r * abs(stop - start) / step))
    return [(c[0] + r * math.cos(start + (stop - start) * i / n), c[1] + r * math.sin(start + (stop - start) * i / n)) for i in range(n)]


def plate(step=0.4):
    """100 x 60 with three corners of radius 8, one chamfer and a round notch of radius 10 on top."""
    q = math.pi / 2
    parts = [
        line((-42, -30), (42, -30), step), arc((42, -22), 8, -q, 0, step), line((50, -22), (50, 22), step), arc((42, 22), 8, 0, q, step),
        line((42, 30), (10, 30), step), arc((0, 30), 10, 0, -math.pi, step), line((-10, 30), (-42, 30), step), line((-42, 30), (-50, 22), step),
        line((-50, 22), (-50, -22), step), arc((-42, -22), 8, 2 * q, 3 * q, step)]
    return [p for part in parts for p in part]


def table(spark, chains, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for chain, points in chains.items():
        p = np.array(points) + rng.normal(0, noise, (len(points), 2)) if noise else np.array(points)
        frames.append(pd.DataFrame({"scan_id": "s", "chain_id": chain, "pos": np.arange(len(p)), "u": p[:, 0], "v": p[:, 1]}))
    return spark.createDataFrame(pd.concat(frames)).withColumn("pos", F.col("pos").cast("int")).repartition(4)


def plain_cost(p, sigma, spacing, opt, penalty):
    """Cost and kind of one range by a direct fit."""
    length = (len(p) - 1) * spacing
    if length < opt.min_length or len(p) < opt.min_points:
        return math.inf, False
    d = p - p.mean(axis=0)
    straight = np.linalg.svd(d, compute_uv=False)[-1] ** 2 / sigma**2 + 3 * penalty
    a = np.column_stack([2 * d, np.ones(len(d))])
    z = (d * d).sum(axis=1)
    (cu, cv, k), *_ = np.linalg.lstsq(a, z, rcond=None)
    square = k + cu * cu + cv * cv
    radius = math.sqrt(max(square, 1e-30))
    bent = math.inf
    if radius <= opt.max_radius and length >= opt.min_sweep * radius:
        bent = ((z - a @ [cu, cv, k]) ** 2).sum() / (4 * square) / sigma**2 + 4 * penalty
    return min(straight, bent), bent < straight


def plain_split(p, sigma, spacing, opt):
    n, penalty = len(p), math.log(len(p))
    best, back = [0.0] + [math.inf] * (n - 1), [0] * n
    for j in range(1, n):
        for i in range(j):
            if math.isfinite(best[i]):
                total = best[i] + plain_cost(p[i:j + 1], sigma, spacing, opt, penalty)[0]
                if total < best[j]:
                    best[j], back[j] = total, i
    out, j = [], n - 1
    while j > 0:
        out.append((back[j], j))
        j = back[j]
    return out[::-1], best[-1]


def open_chain(seed):
    rng = np.random.default_rng(seed)
    return np.array(line((0, 0), (20, 0), 0.5) + arc((20, 6), 6, -math.pi / 2, math.pi / 2, 0.5) + line((20, 12), (5, 12), 0.5)) + rng.normal(0, 0.02, (108, 2))


def split_of(df, sigma, spacing, opt=osp.SplitOptions()):
    scale = df.select("scan_id", "chain_id").distinct().withColumns({"sigma": F.lit(sigma), "spacing": F.lit(spacing)})
    return sorted((r["first"], r["last"], r["arc"]) for r in osp.split_chains(df, scale, opt).collect())


def test_equals_a_plain_dynamic_programme(spark):
    p = open_chain(3)
    got = split_of(table(spark, {1: p}), 0.02, 0.5)
    want, cost = plain_split(p, 0.02, 0.5, osp.SplitOptions())
    assert [g[:2] for g in got] == want
    mine = sum(plain_cost(p[a:b + 1], 0.02, 0.5, osp.SplitOptions(), math.log(len(p)))[0] for a, b, _ in got)
    assert mine == pytest.approx(cost, rel=1e-9)


def test_long_chains_are_split_in_windows(spark, monkeypatch):
    # Forty lines and arcs in a row, windows far shorter than the chain.
    parts, at = [], (0.0, 0.0)
    for k in range(20):
        parts += line(at, (at[0] + 12, at[1]), 0.5)
        parts += arc((at[0] + 12, at[1] + 5), 5, -math.pi / 2, math.pi / 2 if k % 2 else 0.0, 0.5)
        at = (at[0] + 12, at[1] + 10) if k % 2 else (at[0] + 17, at[1] + 5)
    p = np.array(parts) + np.random.default_rng(2).normal(0, 0.005, (len(parts), 2))
    df = table(spark, {1: p, 2: open_chain(5)})
    whole = split_of(df, 0.005, 0.5)
    monkeypatch.setattr(osp, "WINDOW", 128)
    monkeypatch.setattr(osp, "BUCKET_ROWS", 300)
    windows = split_of(df, 0.005, 0.5)
    assert len(whole) == len(windows)
    assert all(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 and a[2] == b[2] for a, b in zip(whole, windows))


@pytest.mark.parametrize("noise,limit", [(0.0, 1e-6), (0.02, 0.15)])
def test_plate_outline(spark, noise, limit):
    p = plate()
    found = osp.split_outlines(table(spark, {7: p, 8: p[40:] + p[:40]}, noise), closed=True).toPandas()
    for chain in (7, 8):
        own = found[found["chain_id"] == chain]
        assert sorted(own["kind"]) == ["arc"] * 4 + ["line"] * 6
        assert sorted(own["radius"].dropna()) == pytest.approx([8, 8, 8, 10], abs=max(limit, 1e-6))
        sweeps = sorted(own["sweep"].dropna())
        assert sweeps == pytest.approx([-math.pi, math.pi / 2, math.pi / 2, math.pi / 2], abs=0.1)
        notch = own[own["radius"] > 9].iloc[0]
        assert math.dist((notch["cu"], notch["cv"]), (0, 30)) < max(limit, 1e-6)
        # Neighbours share their ends around the whole loop.
        ends = sorted((int(a) % len(p), int(b) % len(p)) for a, b in zip(own["first"], own["last"]))
        assert sorted(a for a, _ in ends) == sorted(b for _, b in ends)


def test_circles_lines_and_short_chains(spark):
    circle = arc((3, 4), 20, 0.3, 0.3 + 2 * math.pi, 0.5)
    found = osp.split_outlines(table(spark, {1: circle}, 0.005), closed=True).collect()
    assert [r["kind"] for r in found] == ["arc"] and found[0]["radius"] == pytest.approx(20, abs=0.01)
    assert abs(found[0]["sweep"]) == pytest.approx(2 * math.pi, abs=1e-6)
    chains = {1: line((0, 0), (30, 10), 0.5), 2: [(0.0, 0.0), (0.4, 0.0), (0.8, 0.0)], 3: [(1.0, 1.0)]}
    found = {r["chain_id"]: r for r in osp.split_outlines(table(spark, chains), closed=False).collect()}
    assert set(found) == {1, 2} and all(r["kind"] == "line" for r in found.values())
    assert found[1]["error"] < 1e-9 and abs(math.cos(found[1]["angle"]) * 30 + math.sin(found[1]["angle"]) * 10) < 1e-9
    assert osp.split_outlines(table(spark, chains).limit(0), closed=False).count() == 0


def test_range_fits_match_plain_fits(spark):
    p = open_chain(9)
    df = table(spark, {1: p})
    led = df.alias("a").join(df.select(F.col("pos").alias("q"), F.col("u").alias("u1"), F.col("v").alias("v1")), F.expr("q = pos + 1"), "left").drop("q")
    ranges = spark.createDataFrame([("s", 1, 0, 0, 35), ("s", 1, 1, 42, 70)], "scan_id string, chain_id long, seg long, first long, last long")
    scale = spark.createDataFrame([("s", 1, 0.5)], "scan_id string, chain_id long, spacing double")
    got = {r["seg"]: r for r in osp.best_entity(osp.fit_ranges(led, ranges, scale)).collect()}
    assert got[0]["kind"] == "line" and got[1]["kind"] == "arc"
    q = p[0:36] - p[0:36].mean(axis=0)
    assert got[0]["line_sse"] == pytest.approx(np.linalg.svd(q, compute_uv=False)[-1] ** 2, rel=1e-6)
    q = p[42:71]
    r = np.linalg.norm(q - [got[1]["cu"], got[1]["cv"]], axis=1) - got[1]["radius"]
    assert got[1]["arc_sse"] == pytest.approx((r * r).sum(), rel=1e-9) and got[1]["arc_error"] == pytest.approx(abs(r).max(), rel=1e-9)
    # No step of centre or radius improves the fit.
    j = np.column_stack([-(q - [got[1]["cu"], got[1]["cv"]]) / (r + got[1]["radius"])[:, None], -np.ones(len(q))])
    assert np.abs(np.linalg.lstsq(j, -r, rcond=None)[0]).max() < 1e-7
