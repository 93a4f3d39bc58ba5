"""Relations, snaps and hulls of fitted plane entities; Monte Carlo measurement uncertainty."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions import snapping as sn
from scanweave.functions.vec import frame_from_axis, hypot, stage, vec
from scanweave.operators.measure import measure_pairs
from scanweave.operators.polylines import MOMENTS, line_sse, prefix_moments, range_moments, sorted_neighbours
from scanweave.session import dealt

# Fixed values.
ANGLE_TOL = pi / 180
CENTER_TOL = 0.15
RADIUS_TOL = 0.15
DRAWS = 400


def axis_relations(lines: DataFrame, tol: float = ANGLE_TOL) -> DataFrame:
    """Horizontal and vertical lines `(scan_id, entity_id, angle)` with angles in [0, pi)."""
    a = F.col("angle")
    kind = F.when(F.least(a, pi - a) < tol, "horizontal").when(F.abs(a - pi / 2) < tol, "vertical")
    return lines.select("scan_id", kind.alias("kind"), F.col("entity_id").alias("a")).filter("kind IS NOT NULL")


def direction_relations(lines: DataFrame, tol: float = ANGLE_TOL) -> DataFrame:
    """Neighbours in sorted direction closer than the tolerance: a chain of parallel lines."""
    free = lines.filter((F.least("angle", pi - F.col("angle")) >= tol) & (F.abs(F.col("angle") - pi / 2) >= tol))
    return sorted_neighbours(free, ["scan_id"], "angle", "entity_id", tol).select("scan_id", F.lit("parallel").alias("kind"), "a", "b")


def concentric(rounds: DataFrame, tol: float = CENTER_TOL) -> DataFrame:
    """Arcs and circles whose centres `(cx, cy)` lie within the tolerance; they meet in cells."""
    own = rounds.withColumns({"_i": F.floor(F.col("cx") / tol), "_j": F.floor(F.col("cy") / tol)})
    near = rounds.select("scan_id", F.col("entity_id").alias("b"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    for n, c in (("_i", "_x"), ("_j", "_y")):
        near = near.withColumn(n, F.explode(F.sequence(F.floor(F.col(c) / tol) - 1, F.floor(F.col(c) / tol) + 1)))
    met = own.join(near, ["scan_id", "_i", "_j"]).filter(F.col("entity_id") < F.col("b"))
    return met.filter(hypot(F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")) < tol).select(
        "scan_id", F.lit("concentric").alias("kind"), F.col("entity_id").alias("a"), "b")


def tangents(ends: DataFrame, gap: float) -> DataFrame:
    """Line and arc that share a point and touch: centre distance to the line equals the radius.

    `ends(scan_id, point_id, entity_id, kind, angle, offset, cx, cy, radius)`; `angle` is the
    line's normal angle. Only points where two entities meet count.
    """
    two = ends.groupBy("scan_id", "point_id").agg(F.count("*").alias("_n")).filter("_n = 2").drop("_n")
    at = ends.join(two, ["scan_id", "point_id"])
    line = at.filter("kind = 'line'").select("scan_id", "point_id", F.col("entity_id").alias("a"), "angle", "offset")
    arc = at.filter("kind <> 'line'").select("scan_id", "point_id", F.col("entity_id").alias("b"), "cx", "cy", "radius")
    off = F.abs(F.col("cx") * F.cos("angle") + F.col("cy") * F.sin("angle") - F.col("offset"))
    return line.join(arc, ["scan_id", "point_id"]).filter(F.abs(off - F.col("radius")) <= gap).select(
        "scan_id", F.lit("tangent").alias("kind"), "a", "b").distinct()


def value_snaps(entities: DataFrame, value: str, uncertainty: str, preferred: Column | None = None) -> DataFrame:
    """Entities whose measured value has a design value in its window."""
    s = sn.snap_length(F.col(value), F.col(uncertainty), preferred)
    return entities.withColumn("_s", s).filter("_s IS NOT NULL").select(
        "scan_id", "entity_id", F.col(value).alias("measured"), F.col("_s.value").alias("value"), F.col("_s.step").alias("step"))


def refine_breakpoints(points: DataFrame, breaks: DataFrame, window: int = 12) -> DataFrame:
    """Move the breakpoint between two neighbouring lines `(…, start, split, stop)` to the index of
    least summed squared error, looked up in running sums."""
    keys = ["scan_id", "chain_id"]
    low = F.greatest(F.col("start") + 2, F.col("split") - window)
    high = F.least(F.col("stop") - 2, F.col("split") + window)
    tries = breaks.withColumn("_k", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array("split"))))
    prefix = prefix_moments(points)
    base = [*keys, "start", "split", "stop", "_k"]

    def cost(i: str, j: str, name: str) -> DataFrame:
        r = tries.select(*base, F.col(i).alias("i"), F.col(j).alias("j"))
        return range_moments(prefix, r).select(*base, line_sse().alias(name))

    both = cost("start", "_k", "_a").join(cost("_k", "stop", "_b"), base)
    best = both.groupBy(*keys, "start", "split", "stop").agg(
        F.min_by("_k", F.struct(F.round(F.col("_a") + F.col("_b"), 9), "_k")).alias("moved"))
    return best


def _chain(points: np.ndarray) -> np.ndarray:
    """Convex hull of plane points, counter-clockwise from the lowest x."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    halves = []
    for order in (p, p[::-1]):
        kept: list[np.ndarray] = []
        for q in order:
            while len(kept) > 1 and np.cross(np.append(kept[-1] - kept[-2], 0), np.append(q - kept[-2], 0))[2] <= 0:
                kept.pop()
            kept.append(q)
        halves.append(kept[:-1])
    return np.array(halves[0] + halves[1])


def convex_hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """Hull corners `(…, pos, u, v)` per key: hulls of each partition first, then of their corners."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                hull = _chain(rows[["u", "v"]].to_numpy())
                out = pd.DataFrame(hull, columns=["u", "v"])
                for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[name] = value
                yield out[[*keys, "u", "v"]]

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _chain(rows[["u", "v"]].to_numpy())
        out = pd.DataFrame(hull, columns=["u", "v"])
        for name in keys:
            out[name] = rows[name].iloc[0]
        out["pos"] = np.arange(len(hull))
        return out[[*keys, "pos", "u", "v"]]

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    small = points.select(*keys, "u", "v").mapInPandas(partial, f"{head}, u double, v double")
    return small.groupBy(*keys).applyInPandas(final, f"{head}, pos long, u double, v double")


def beyond_hull(points: DataFrame, hulls: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """Share of the points of every key that lie outside the hull of the same key.

    A hull becomes one row of half-planes, so a point meets it without repeating.
    """
    nxt = hulls.select(*keys, F.struct("pos", "u", "v").alias("_c")).groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_h"))
    size = F.size("_h")
    side = F.transform(F.sequence(F.lit(0), size - 1), lambda k: (
        (F.get(F.col("_h"), (k + 1) % size)["v"] - F.get(F.col("_h"), k)["v"]) * (F.col("u") - F.get(F.col("_h"), k)["u"])
        - (F.get(F.col("_h"), (k + 1) % size)["u"] - F.get(F.col("_h"), k)["u"]) * (F.col("v") - F.get(F.col("_h"), k)["v"])
    ) / F.greatest(hypot(F.get(F.col("_h"), (k + 1) % size)["u"] - F.get(F.col("_h"), k)["u"], F.get(F.col("_h"), (k + 1) % size)["v"] - F.get(F.col("_h"), k)["v"]), F.lit(1e-300)))
    out = points.join(nxt, keys).withColumn("_d", F.array_max(side))
    return out.groupBy(*keys).agg(F.avg((F.col("_d") > slack).cast("double")).alias("share"), F.max("_d").alias("farthest"))


def _normal(seed: int, *columns) -> Column:
    """Standard normal numbers from hashes of the row: the same under any partitioning."""
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *columns), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    return F.sqrt(-2 * F.log(draw(0))) * F.cos(2 * pi * draw(1))


def measurement_sigma(items: DataFrame, pairs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """One-sigma of measured distance and angle when fitted items move within their uncertainty.

    `items` carry `tilt_sigma`, `shift_sigma` and `size_sigma`. Every pair is measured `draws`
    times; a value needs at least half of the draws.
    """
    e, g = frame_from_axis(vec("n"))
    own = stage(dealt(items, "scan_id", "item_id", rows=2_000), _e=e, _g=g)
    n = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    drawn = own.select("*", n)
    noise = {k: _normal(10 * s, "scan_id", "item_id", "draw") for s, k in enumerate(("t1", "t2", "s1", "s2", "s3", "d"), start=1)}
    drawn = drawn.withColumns({f"_{k}": c for k, c in noise.items()})
    tilt = vec("n") + vec("_e") * (F.col("_t1") * F.col("tilt_sigma")) + vec("_g") * (F.col("_t2") * F.col("tilt_sigma"))
    at = vec("o") + (vec("_e") * F.col("_s1") + vec("_g") * F.col("_s2") + vec("n") * F.col("_s3")) * F.col("shift_sigma")
    drawn = stage(drawn, _n=tilt)
    shaken = drawn.select(
        F.concat_ws("#", "scan_id", "draw").alias("scan_id"), "item_id", "item", (F.col("diameter") + F.col("_d") * F.col("size_sigma")).alias("diameter"),
        *at.named("o"), *vec("_n").unit().named("n"))
    each = dealt(pairs, "scan_id", "a", "b", rows=2_000).select("scan_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(
        F.concat_ws("#", "scan_id", "draw").alias("scan_id"), "a", "b")
    # Both sides hold a row per draw, which their sizes do not tell beforehand: neither may be broadcast.
    values = measure_pairs(shaken.hint("merge"), each).withColumn("scan_id", F.substring_index("scan_id", "#", 1))
    nominal = measure_pairs(items, pairs).select("scan_id", "a", "b", F.col("distance").alias("d0"), F.col("angle_deg").alias("a0"))
    row = values.join(nominal, ["scan_id", "a", "b"])
    spread = lambda v, ref: F.when(F.count(F.col(v) - F.col(ref)) >= draws // 2, F.sqrt(F.avg((F.col(v) - F.col(ref)) ** 2)))
    return row.groupBy("scan_id", "a", "b").agg(spread("distance", "d0").alias("distance_sigma"), spread("angle_deg", "a0").alias("angle_sigma"))
