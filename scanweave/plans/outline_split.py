"""Splitting evenly sampled polylines into lines and arcs.

A split is the cheapest sequence of segments under squared errors and a penalty per entity (the
Bayesian information criterion), found by dynamic programming over the samples. A chain of up to
WINDOW samples is solved in one piece. A longer one is solved in overlapping windows of samples, the
breakpoints well inside each window become the candidates of the next level, where the sums between
neighbouring candidates stand for all samples, and so on until the candidates of every chain fit one
window. No task holds more than some windows, whatever the length of a chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import hypot
from scanweave.operators import polylines as pl
from scanweave.operators.polylines import CHAIN
from scanweave.session import cut, cut_counting

WINDOW = 512
#: Breakpoints this close to the border between two windows are taken from both.
MARGIN = 8
BUCKET_ROWS = 16_384
RANGE_BLOCK = 1_024
CIRCLE_ROUNDS = 15
CIRCLE_SETTLED = 1e-9
SEGMENT = [*CHAIN, "seg"]


@dataclass(frozen=True)
class SplitOptions:
    tolerance: float = 0.1
    """Largest distance of a point from its entity."""
    max_radius: float = 1000.0
    """Larger arcs are lines."""
    min_sweep: float = math.radians(8.0)
    min_points: int = 5
    min_length: float = 1.0
    """Shorter entities are the rounding of scan corners."""


MOMENTS = pl.MOMENTS


def _terms(u: Column, v: Column) -> dict[str, Column]:
    z = u * u + v * v
    return dict(zip(MOMENTS, (F.lit(1.0), u, v, u * u, u * v, v * v, u * z, v * z, z, z * z)))


def _costs(m: np.ndarray, length: np.ndarray, sigma: float, penalty: float, opt: SplitOptions) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest entity over ranges with moments `m` (10 rows), and whether it is an arc."""
    n, su, sv, suu, suv, svv, suz, svz, sz, szz = m
    a, b, c = suu - su * su / n, suv - su * sv / n, svv - sv * sv / n
    p, q, w = suz - su * sz / n, svz - sv * sz / n, np.maximum(szz - sz * sz / n, 0)
    line = np.maximum((a + c) / 2 - np.sqrt((a - c) ** 2 / 4 + b * b), 0) / sigma**2 + 3 * penalty
    det = a * c - b * b
    flat = det <= 1e-12 * (a + c) ** 2
    det = np.where(flat, 1.0, det)
    cu, cv = (p * c - q * b) / (2 * det), (a * q - b * p) / (2 * det)
    square = np.maximum(cu * cu + cv * cv + (sz - 2 * cu * su - 2 * cv * sv) / n, 1e-30)
    radius = np.sqrt(square)
    arc = np.maximum(w - 2 * cu * p - 2 * cv * q, 0) / (4 * square) / sigma**2 + 4 * penalty
    arc[flat | (radius > opt.max_radius) | (length < opt.min_sweep * radius)] = np.inf
    short = (length < opt.min_length) | (n < opt.min_points)
    line[short] = arc[short] = np.inf
    return np.minimum(line, arc), arc < line


def best_split(own: np.ndarray, gaps: np.ndarray, pos: np.ndarray, sigma: float, spacing: float, penalty: float, opt: SplitOptions) -> list[tuple[int, int, bool]]:
    """(first, last, arc) of the segments of the cheapest split between candidates 0 and len - 1.

    `own` are the moments of the candidates' points, `gaps` those of the samples after the previous
    candidate up to each. Neighbours share a candidate. Too short a chain is one line.
    """
    k = len(pos)
    upto = np.cumsum(gaps, axis=0)
    best = np.full(k, np.inf)
    best[0] = 0.0
    back, arcs = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=bool)
    for end in range(1, k):
        cost, arc = _costs((upto[end] - upto[:end] + own[:end]).T, (pos[end] - pos[:end]) * spacing, sigma, penalty, opt)
        total = best[:end] + cost
        first = int(np.argmin(total))
        best[end], back[end], arcs[end] = total[first], first, arc[first]
    if not np.isfinite(best[-1]):
        return [(0, k - 1, False)]
    out, end = [], k - 1
    while end > 0:
        out.append((int(back[end]), end, bool(arcs[end])))
        end = int(back[end])
    return out[::-1]


_WINDOWED = ("scan_id string, chain_id long, pos long, u double, v double, arc boolean, count long, single boolean, "
             "sigma double, spacing double, penalty double, cu double, cv double")


def _solve(frame: pd.DataFrame, opt: SplitOptions, margin: int) -> pd.DataFrame:
    """Accepted breakpoints of some windows; each row also tells the kind of the segment that ends there."""
    out = []
    for _, part in frame.groupby([*CHAIN, "win"], sort=False):
        part = part.sort_values("rank")
        u, v = part["u"].to_numpy() - part["cu"].iloc[0], part["v"].to_numpy() - part["cv"].iloc[0]
        z = u * u + v * v
        own = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v, u * z, v * z, z, z * z], axis=1)
        first = part.iloc[0]
        path = best_split(own, part[MOMENTS].to_numpy(), part["pos"].to_numpy(), first["sigma"], first["spacing"], first["penalty"], opt)
        rank, half, count = part["rank"].to_numpy(), WINDOW // 2, int(first["count"])
        single = count <= WINDOW + 1
        low = 0 if first["win"] == 0 else first["win"] * half + half // 2 - margin
        high = count if rank[-1] == count - 1 else first["win"] * half + half + half // 2 + margin
        at = [0] + [end for _, end, _ in path]
        kind = [False] + [arc for _, _, arc in path]
        keep = [(i, arc) for i, arc in zip(at, kind) if (low <= rank[i] < high and 0 < i < len(part) - 1) or rank[i] in (0, count - 1)]
        rows = part.iloc[[i for i, _ in keep]][[*CHAIN, "pos", "u", "v", "sigma", "spacing", "penalty", "cu", "cv"]].copy()
        rows["arc"], rows["count"], rows["single"] = [arc for _, arc in keep], count, single
        out.append(rows)
    names = [f.split()[0] for f in _WINDOWED.split(", ")]
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def _level(candidates: DataFrame, opt: SplitOptions, margin: int) -> DataFrame:
    """One level: `candidates(…, pos, rank, count, moments)` cut to the breakpoints of all windows."""
    half = WINDOW // 2
    last = F.greatest(F.floor((F.col("count") - 2) / half) - 1, F.lit(0))
    win = F.floor(F.col("rank") / half)
    # A window holds `WINDOW` steps; its first and last candidate are shared with other windows.
    own = F.array_distinct(F.array(win, win - 1, F.when(F.col("rank") % half == 0, win - 2).otherwise(win)))
    rows = candidates.withColumn("win", F.explode(F.filter(own, lambda w: (w >= 0) & (w <= last))))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*CHAIN, "win"), F.lit(buckets)))
    return rows.groupBy("_bucket").applyInPandas(lambda f: _solve(f, opt, margin), _WINDOWED)


def _ranked(samples: DataFrame, found: DataFrame) -> DataFrame:
    """The breakpoints as candidates of the next level, with the sums of the samples between them."""
    marks = found.groupBy(*CHAIN, "pos").agg(*[F.first(c).alias(c) for c in ("u", "v", "sigma", "spacing", "penalty", "cu", "cv")])
    marked = samples.select(*CHAIN, "pos", "u", "v").join(marks.select(*CHAIN, "pos", F.lit(1.0).alias("_mark")), [*CHAIN, "pos"], "left")
    marked = pl.running_sums(marked.withColumn("_mark", F.coalesce("_mark", F.lit(0.0))), {"_upto": F.col("_mark")})
    # A candidate closes the gap before it: samples count for the next candidate.
    gap = F.when(F.col("_mark") == 1, F.col("_upto") - 1).otherwise(F.col("_upto")).cast("long")
    centre = marks.select(*CHAIN, "cu", "cv").dropDuplicates(CHAIN)
    placed = marked.withColumn("rank", gap).join(centre, CHAIN)
    sums = placed.groupBy(*CHAIN, "rank").agg(*[F.sum(t).alias(n) for n, t in _terms(F.col("u") - F.col("cu"), F.col("v") - F.col("cv")).items()])
    at = placed.filter("_mark = 1").select(*CHAIN, "pos", "rank")
    counts = marks.groupBy(*CHAIN).agg(F.count("*").alias("count"))
    return marks.join(at, [*CHAIN, "pos"]).join(sums, [*CHAIN, "rank"]).join(counts, CHAIN)


def split_chains(samples: DataFrame, scale: DataFrame, opt: SplitOptions = SplitOptions()) -> DataFrame:
    """Segments `(scan_id, chain_id, seg, first, last, arc)` of open chains `samples(…, pos, u, v)`.

    Positions of a chain run from 0 without gaps; `scale(scan_id, chain_id, sigma, spacing)` tells the
    noise and the distance of samples. `first` and `last` are positions, shared by neighbours.
    """
    samples = cut(samples.select(*CHAIN, F.col("pos").cast("long").alias("pos"), "u", "v"))
    whole = samples.groupBy(*CHAIN).agg(F.count("*").alias("count"), F.avg("u").alias("cu"), F.avg("v").alias("cv"))
    whole = cut(whole.filter("count > 1").join(scale.select(*CHAIN, "sigma", "spacing"), CHAIN).withColumns({
        "sigma": F.greatest("sigma", F.lit(1e-6)), "penalty": F.log("count")}))
    rows = samples.join(whole, CHAIN).withColumn("rank", F.col("pos"))
    candidates = rows.withColumns(_terms(F.col("u") - F.col("cu"), F.col("v") - F.col("cv")))
    total = None
    while True:
        found = cut(_level(candidates, opt, MARGIN))
        size = found.agg(F.count("*").alias("n"), F.min("single").alias("single")).first()
        if size["single"] is None or size["single"]:
            break
        if total is not None and size["n"] >= total:
            # Every window is full of breakpoints: each decides for its own part.
            found = cut(_level(candidates, opt, 0))
            break
        total = size["n"]
        candidates = cut(_ranked(samples, found))
    ends = found.groupBy(*CHAIN, "pos").agg(F.max("arc").alias("arc"))
    w = pl.running_sums(ends, {"_k": F.lit(1.0)}).withColumn("_k", F.col("_k").cast("long"))
    before = w.select(*CHAIN, (F.col("_k") + 1).alias("_k"), F.col("pos").alias("first"))
    return w.join(before, [*CHAIN, "_k"]).select(*CHAIN, (F.col("_k") - 2).alias("seg"), "first", F.col("pos").alias("last"), "arc")


# ---------------------------------------------------------------- fits of ranges


def members(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """The samples of every range `(…, seg, first, last)`; ranges may overlap and have any length."""
    block = lambda c: F.floor(F.col(c) / RANGE_BLOCK)
    spread = ranges.withColumn("_block", F.explode(F.sequence(block("first"), block("last"))))
    return samples.withColumn("_block", block("pos")).join(spread, [*CHAIN, "_block"]).filter(F.col("pos").between(F.col("first"), F.col("last"))).drop("_block")


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Total-least-squares line and hyper-accurate algebraic circle from centred moments."""
    for b in batches:
        n, su, sv, suu, suv, svv, suz, svz, sz, szz = (b[c].to_numpy() / b["m_n"].to_numpy() if c != "m_n" else b[c].to_numpy() for c in MOMENTS)
        a, c, d = suu - su * su, svv - sv * sv, suv - su * sv
        angle = 0.5 * np.arctan2(2 * d, a - c) + math.pi / 2
        nu, nv = np.cos(angle), np.sin(angle)
        out = b[[*SEGMENT]].copy()
        out["nu"], out["nv"], out["offset"] = nu, nv, (su + b["ou"]) * nu + (sv + b["ov"]) * nv
        # Moments about the centroid, scaled to unit spread: z = u² + v².
        mu, mv = su, sv
        scale = np.sqrt(np.maximum(a + c, 1e-300))
        z2 = a + c
        uz = suz - 2 * mu * suu - 2 * mv * suv - mu * (sz - 2 * mu * su - 2 * mv * sv) + (mu * mu + mv * mv) * (su - mu)
        vz = svz - 2 * mu * suv - 2 * mv * svv - mv * (sz - 2 * mu * su - 2 * mv * sv) + (mu * mu + mv * mv) * (sv - mv)
        r2 = mu * mu + mv * mv
        zz = szz - 4 * mu * suz - 4 * mv * svz + 4 * mu * mu * suu + 8 * mu * mv * suv + 4 * mv * mv * svv + 2 * r2 * sz - 4 * r2 * (mu * su + mv * sv) + r2 * r2
        zz, uz, vz, z2, uu, uv, vv = zz / scale**4, uz / scale**3, vz / scale**3, z2 / scale**2, a / scale**2, d / scale**2, c / scale**2
        m = np.zeros((len(b), 4, 4))
        for (i, j), value in {(0, 0): zz, (0, 1): uz, (0, 2): vz, (0, 3): z2, (1, 1): uu, (1, 2): uv, (2, 2): vv}.items():
            m[:, i, j] = m[:, j, i] = value
        m[:, 3, 3] = 1.0
        limit = np.zeros((len(b), 4, 4))
        limit[:, 0, 0], limit[:, 0, 3], limit[:, 3, 0], limit[:, 1, 1], limit[:, 2, 2] = 8 * z2, 2, 2, 1, 1
        cu, cv, radius = (np.full(len(b), np.nan) for _ in range(3))
        sound = np.isfinite(m).all(axis=(1, 2)) & (n >= 3)
        if sound.any():
            values, vectors = np.linalg.eig(np.linalg.solve(limit[sound], m[sound]))
            values = np.where(np.abs(values.imag) > 1e-9 * (1 + np.abs(values.real)), np.inf, values.real)
            pick = np.argmin(np.where(values > -1e-12, values, np.inf), axis=1)
            A, B, C, D = vectors.real[np.arange(len(pick)), :, pick].T
            with np.errstate(all="ignore"):
                square = (B * B + C * C - 4 * A * D) / (4 * A * A)
                good = (np.abs(A) > 1e-12) & (square > 0)
                s, at = scale[sound], np.flatnonzero(sound)
                cu[at] = np.where(good, -B / (2 * A) * s, np.nan) + mu[sound] + b["ou"].to_numpy()[sound]
                cv[at] = np.where(good, -C / (2 * A) * s, np.nan) + mv[sound] + b["ov"].to_numpy()[sound]
                radius[at] = np.where(good, np.sqrt(square) * s, np.nan)
        out["cu"], out["cv"], out["radius"], out["points"] = cu, cv, radius, n.astype(np.int64)
        yield out


_FIT = "scan_id string, chain_id long, seg long, nu double, nv double, offset double, cu double, cv double, radius double, points long"


def _circle_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        m = np.empty((len(b), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                m[:, i, j] = m[:, j, i] = b[f"m_{i}_{j}"]
        rhs = -b[["v_0", "v_1", "v_2"]].to_numpy()
        lift = 1e-13 * np.einsum("kii->k", m)[:, None, None] * np.eye(3) + 1e-300 * np.eye(3)
        step = np.linalg.solve(m + lift, rhs[..., None])[..., 0]
        step = np.where(np.isfinite(step).all(axis=1, keepdims=True), step, 0.0)
        out = b[SEGMENT].copy()
        for k, name in enumerate(("cu", "cv", "radius")):
            out[name] = b[name] + step[:, k]
        out["moved"] = np.linalg.norm(step, axis=1) / np.maximum(1.0, b["radius"].to_numpy())
        yield out


def _refined(rows: DataFrame, circles: DataFrame) -> DataFrame:
    """Gauss-Newton on the distances from the circle, all ranges in one pass a round."""
    done = []
    current = circles.withColumn("moved", F.lit(1.0))
    for _ in range(CIRCLE_ROUNDS):
        at = rows.join(current.drop("moved"), SEGMENT)
        du, dv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
        at = at.withColumn("_rho", F.greatest(hypot(du, dv), F.lit(1e-12)))
        r = F.col("_rho") - F.col("radius")
        j = [-du / F.col("_rho"), -dv / F.col("_rho"), F.lit(-1.0)]
        sums = at.groupBy(*SEGMENT, "cu", "cv", "radius").agg(
            *[F.sum(j[a] * j[b]).alias(f"m_{a}_{b}") for a in range(3) for b in range(a, 3)], *[F.sum(j[a] * r).alias(f"v_{a}") for a in range(3)])
        schema = "scan_id string, chain_id long, seg long, cu double, cv double, radius double, moved double"
        stepped, moving = cut_counting(sums.mapInPandas(_circle_step, schema), F.col("moved") >= CIRCLE_SETTLED)
        done.append(stepped.filter(F.col("moved") < CIRCLE_SETTLED))
        current = stepped.filter(F.col("moved") >= CIRCLE_SETTLED)
        if not moving:
            break
    out = current
    for part in done:
        out = out.unionByName(part)
    return out.drop("moved")


def fit_ranges(samples: DataFrame, ranges: DataFrame, spacing: DataFrame, opt: SplitOptions = SplitOptions(), exact: bool = True) -> DataFrame:
    """Line and circle of every range, each with its sum of squares, largest error and largest inner error, and the arc's sweep.

    `samples(…, pos, u, v, u1, v1)` carry the next point. Inner errors leave out what lies within
    `min_length` of either end, where scan corners are rounded into the neighbours. Without `exact`
    circles are the algebraic ones, close enough to judge by.
    """
    origin = samples.select(*CHAIN, F.col("pos").alias("first"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    rows = cut(members(samples, ranges.select(*SEGMENT, "first", "last").join(origin, [*CHAIN, "first"])))
    moments = rows.groupBy(*SEGMENT, "ou", "ov").agg(*[F.sum(t).alias(n) for n, t in _terms(F.col("u") - F.col("ou"), F.col("v") - F.col("ov")).items()])
    start = cut(moments.mapInPandas(_start, _FIT))
    circles = start.filter(~F.isnan("radius")).select(*SEGMENT, "cu", "cv", "radius")
    circles = _refined(rows, circles) if exact else circles
    fits = start.drop("cu", "cv", "radius").join(circles, SEGMENT, "left").join(spacing.select(*CHAIN, "spacing"), CHAIN)
    fits = cut(fits) if exact else fits
    at = rows.join(fits, SEGMENT)
    line = F.abs(F.col("u") * F.col("nu") + F.col("v") * F.col("nv") - F.col("offset"))
    du, dv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
    eu, ev = F.col("u1") - F.col("cu"), F.col("v1") - F.col("cv")
    circle = F.abs(hypot(du, dv) - F.col("radius"))
    along, left = (F.col("pos") - F.col("first")) * F.col("spacing"), (F.col("last") - F.col("pos")) * F.col("spacing")
    inner = (along > opt.min_length) & (left > opt.min_length)
    turn = F.when(F.col("pos") < F.col("last"), F.atan2(du * ev - dv * eu, du * eu + dv * ev))
    measured = at.groupBy(*SEGMENT).agg(
        *[f.alias(f"{name}_{what}") for name, e in (("line", line), ("arc", circle)) for what, f in (
            ("sse", F.sum(e * e)), ("error", F.max(e)), ("inner", F.coalesce(F.max(F.when(inner, e)), F.max(e))))],
        F.sum(turn).alias("sweep"))
    return ranges.join(fits.drop("spacing"), SEGMENT).join(measured, SEGMENT)


def arc_allowed(opt: SplitOptions) -> Column:
    return F.coalesce((F.col("radius") <= opt.max_radius) & (F.abs("sweep") >= opt.min_sweep) & (F.col("points") >= opt.min_points), F.lit(False))


def best_entity(fits: DataFrame, opt: SplitOptions = SplitOptions(), error: str = "error") -> DataFrame:
    """`kind` of `fit_ranges`: a line within tolerance, else an allowed arc within tolerance, else null."""
    arc = arc_allowed(opt) & (F.col(f"arc_{error}") <= opt.tolerance)
    return fits.withColumn("kind", F.when(F.col(f"line_{error}") <= opt.tolerance, "line").when(arc, "arc"))


# ---------------------------------------------------------------- whole outlines


def opened(samples: DataFrame, start: DataFrame) -> DataFrame:
    """Closed chains turned to begin at `start(scan_id, chain_id, start)`, with the first point repeated at the end."""
    n = samples.groupBy(*CHAIN).agg(F.count("*").alias("_n"))
    turned = samples.join(n.join(start, CHAIN), CHAIN).withColumn("_at", F.pmod(F.col("pos") - F.col("start"), F.col("_n")).cast("long"))
    twice = F.when(F.col("_at") == 0, F.array(F.col("_at"), F.col("_n"))).otherwise(F.array("_at"))
    return turned.select(*CHAIN, F.explode(twice).alias("pos"), "u", "v", "start")


def _sharpest(angles: DataFrame) -> DataFrame:
    sharp = angles.groupBy(*CHAIN).agg(F.max(F.struct(F.round("angle", 9).alias("angle"), (-F.col("pos")).alias("before"))).alias("_s"))
    return sharp.select(*CHAIN, (-F.col("_s.before")).cast("long").alias("start"))


def _merge_round(segments: DataFrame, samples: DataFrame, scale: DataFrame, opt: SplitOptions, closed: bool) -> DataFrame | None:
    """Segments after merging neighbours that one entity describes; None when nothing merges."""
    size = segments.groupBy(*CHAIN).agg(F.count("*").alias("_count")).join(scale.select(*CHAIN, F.col("points").alias("_end")), CHAIN)
    right = segments.select(*CHAIN, "seg", F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("arc").alias("_arc"))
    pairs = segments.join(size, CHAIN).withColumn("_next", F.col("seg") + 1)
    if closed:
        pairs = pairs.withColumn("_next", F.when((F.col("_next") == F.col("_count")) & (F.col("_count") > 2), F.lit(0)).otherwise(F.col("_next")))
    pairs = pairs.join(right.withColumnRenamed("seg", "_next"), [*CHAIN, "_next"])
    wraps = F.col("_f") < F.col("last")
    pairs = cut(pairs.select(*SEGMENT, "first", F.when(wraps, F.col("_l") + F.col("_end")).otherwise(F.col("_l")).alias("last"),
                             (F.col("arc") & F.col("_arc")).alias("both"), "_next", "_count"))
    fits = best_entity(fit_ranges(samples, pairs, scale, opt, exact=False), opt, "inner")
    fits = fits.filter((F.col("kind") == "line") | ((F.col("kind") == "arc") & F.col("both")))
    error = F.when(F.col("kind") == "line", F.col("line_inner")).otherwise(F.col("arc_inner"))
    good, any_ = cut_counting(fits.select(*SEGMENT, "first", "last", "_next", (F.col("kind") == "arc").alias("arc"), error.alias("error")), F.lit(True))
    if not any_:
        return None
    # Of pairs that share a segment, the one with the smaller error goes first.
    touch = good.select(*CHAIN, F.explode(F.array("seg", "_next")).alias("part"), F.struct("error", "seg").alias("_e"))
    least = touch.groupBy(*CHAIN, "part").agg(F.min("_e").alias("_e"))
    wins = touch.join(least, [*CHAIN, "part", "_e"]).groupBy(*CHAIN, F.col("_e.seg").alias("seg")).agg(F.count("*").alias("_n")).filter("_n = 2")
    chosen = good.join(wins.select(*SEGMENT), SEGMENT, "left_semi")
    gone = chosen.select(*CHAIN, F.explode(F.array("seg", "_next")).alias("seg"))
    merged = segments.select(*SEGMENT, "first", "last", "arc").join(gone, SEGMENT, "left_anti").unionByName(chosen.select(*SEGMENT, "first", "last", "arc"))
    order = cut(merged)
    nth = pl.running_sums(order.withColumnRenamed("seg", "pos"), {"_k": F.lit(1.0)})
    return cut(nth.select(*CHAIN, (F.col("_k") - 1).cast("long").alias("seg"), "first", "last", "arc"))


def split_outlines(samples: DataFrame, closed: bool, opt: SplitOptions = SplitOptions(), spacing: float | None = None) -> DataFrame:
    """Entities of evenly sampled chains: kind, positions, line and circle parameters, errors.

    The noise is measured on the chains. Closed chains start at their sharpest corner; positions are
    those of the input, `last` beyond the end where a segment passes the seam. Chains of less than
    two points have no entities; a chain without corners is one arc or line.
    """
    samples = cut(samples.select(*CHAIN, "pos", "u", "v"))
    noise = pl.noise(samples, closed).select(*CHAIN, F.col("noise").alias("sigma"), "points")
    length = pl.arc_lengths(samples, closed).groupBy(*CHAIN).agg(F.avg("step").alias("spacing"))
    scale = cut(noise.join(length, CHAIN).withColumn("spacing", F.lit(spacing) if spacing else F.col("spacing")))
    if closed:
        # A first split from the sharpest corner; the sharpest of its junctions is where the second begins,
        # because a start inside an entity leaves a piece of it too short to stand.
        angles = cut(pl.turning_angles(samples, 3))
        rough = cut(samples.select(*CHAIN).distinct().join(_sharpest(angles), CHAIN, "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long"))))
        first = split_chains(cut(opened(samples, rough)), scale, opt).filter("first > 0")
        at = first.join(rough, CHAIN).join(scale.select(*CHAIN, F.col("points").alias("_n")), CHAIN)
        at = at.select(*CHAIN, F.pmod(F.col("first") + F.col("start"), F.col("_n")).alias("pos"))
        better = _sharpest(at.join(angles, [*CHAIN, "pos"])).withColumnRenamed("start", "_better")
        start = rough.join(better, CHAIN, "left").select(*CHAIN, F.coalesce("_better", "start").alias("start"))
        line = cut(opened(samples, start))
    else:
        line = samples.withColumn("start", F.lit(0).cast("long"))
    segments = cut(split_chains(line, scale, opt))
    n = line.groupBy(*CHAIN).agg(F.max("pos").alias("_n"), F.max("start").alias("start"))
    if closed:
        # A second lap, so that ranges may pass the seam.
        lap = line.join(n.select(*CHAIN, "_n"), CHAIN).filter(F.col("pos") > 0)
        line = line.unionByName(lap.select(*CHAIN, (F.col("pos") + F.col("_n")).alias("pos"), "u", "v", "start"))
    led = cut(pl.windowed(line.drop("start"), 1, {"u1": lambda w: F.lead("u").over(w), "v1": lambda w: F.lead("v").over(w)}))
    while True:
        merged = _merge_round(segments, led, scale, opt, closed)
        if merged is None:
            break
        segments = merged
    fits = fit_ranges(led, segments, scale, opt)
    arc = F.col("arc") & arc_allowed(opt)
    out = fits.withColumn("kind", F.when(arc, "arc").otherwise("line")).join(n, CHAIN)
    back = F.floor((F.col("first") + F.col("start")) / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1)) * F.col("_n")
    shift = F.col("start") - back if closed else F.lit(0)
    pick = lambda what: F.when(F.col("kind") == "arc", F.col(f"arc_{what}")).otherwise(F.col(f"line_{what}"))
    return out.select(
        *SEGMENT, "kind", (F.col("first") + shift).cast("long").alias("first"), (F.col("last") + shift).cast("long").alias("last"), "points",
        F.when(F.col("kind") == "line", F.atan2("nv", "nu")).alias("angle"), F.when(F.col("kind") == "line", F.col("offset")).alias("offset"),
        *[F.when(F.col("kind") == "arc", F.col(c)).alias(c) for c in ("cu", "cv", "radius", "sweep")], pick("sse").alias("sse"), pick("error").alias("error"))
