"""Bolt circles and rounded edges."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanweave.functions.vec import clamp, hypot, stage, vec
from scanweave.operators.graph import components
from scanweave.operators.polylines import sorted_neighbours
from scanweave.operators.spatial import within_balls
from scanweave.session import cut

# Fixed values.
SLAB = 0.25
REACH = 5.0
RADIUS_STEPS = 48
FINE_STEPS = 25
MIN_SECTION_POINTS = 8


def bolt_circles(circles: DataFrame, radius_tol: float, position_tol: float) -> DataFrame:
    """Groups of equal circles `(scan_id, entity_id, cx, cy, radius)` evenly spread on one circle.

    Equal radii chain up, the centres get an algebraic circle, and the gaps of the sorted angles
    must agree: all of them, or all but the largest (a partial pattern). A group holds the
    holes of one sketch.
    """
    links = sorted_neighbours(circles, ["scan_id"], "radius", "entity_id", radius_tol)
    rows = cut(circles.join(components(circles.select("scan_id", "entity_id"), links, node="entity_id"), ["scan_id", "entity_id"]))
    key = ["scan_id", "part"]
    x, y = F.col("cx"), F.col("cy")
    z = x * x + y * y
    m = rows.groupBy(*key).agg(
        F.count("*").alias("holes"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"),
        F.var_pop(y).alias("c"), F.covar_pop(x, z).alias("p"), F.covar_pop(y, z).alias("q")).filter("holes >= 3")
    det = F.col("a") * F.col("c") - F.col("b") ** 2
    m = m.filter(det > 1e-12).withColumns({"u": (F.col("p") * F.col("c") - F.col("q") * F.col("b")) / (2 * det), "v": (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / (2 * det)})
    m = m.withColumn("pitch", F.sqrt(F.greatest(F.col("mz") - 2 * F.col("u") * F.col("mx") - 2 * F.col("v") * F.col("my") + F.col("u") ** 2 + F.col("v") ** 2, F.lit(0.0))))
    at = rows.join(m.select(*key, "holes", "u", "v", "pitch"), key).withColumns({
        "_miss": F.abs(hypot(x - F.col("u"), y - F.col("v")) - F.col("pitch")), "_angle": F.atan2(y - F.col("v"), x - F.col("u"))})
    w = W.partitionBy(*key).orderBy("_angle", "entity_id")
    whole = W.partitionBy(*key)
    nxt = F.coalesce(F.lead("_angle").over(w), F.min("_angle").over(whole) + 2 * pi)
    g = at.withColumn("_gap", nxt - F.col("_angle")).withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_gap"), "entity_id")))
    inner = F.when(F.col("_rank") > 1, F.col("_gap"))
    s = g.groupBy(*key, "holes", "u", "v", "pitch").agg(
        F.max("_miss").alias("_miss"), F.max("_gap").alias("_top"), F.max(inner).alias("_hi"), F.min(inner).alias("_lo"), F.avg(inner).alias("step"))
    # A hole may be off by the position tolerance along the circle at both ends of a gap.
    slack = 2 * position_tol / F.greatest("pitch", F.lit(1e-9))
    even = (F.col("_miss") <= position_tol) & (F.col("_hi") - F.col("_lo") <= slack)
    full = F.col("_top") - F.col("_lo") <= slack
    count = F.rint(2 * pi / F.col("step"))
    fits = F.abs(F.col("step") * count - 2 * pi) <= slack * count
    return s.filter(even & (full | fits)).select(*key, "holes", "u", "v", "pitch", F.when(full, F.col("holes")).otherwise(count.cast("long")).alias("places"), full.alias("complete"))


def _corner_distance(radius: Column) -> Column:
    """Distance of the local point `(s, t)` to a corner of two faces rounded with a radius.

    The first face runs along s; the second leaves the corner at the angle `opening`.
    """
    s, t, half = F.col("s"), F.col("t"), F.col("opening") / 2
    along = s * F.cos("opening") + t * F.sin("opening")
    across = t * F.cos("opening") - s * F.sin("opening")
    reach = radius / F.tan(half)
    cx, cy = radius / F.tan(half), radius
    arc = F.abs(hypot(s - cx, t - cy) - radius)
    flat = F.when(s >= along, F.abs(t)).otherwise(F.abs(across))
    return F.when(F.greatest(s, along) >= reach, flat).otherwise(arc)


def section_radii(points: DataFrame, frames: DataFrame, noise: float, reach: float = REACH) -> DataFrame:
    """Radius of a rounded edge in every cross-section, by least capped squared distance.

    `frames(scan_id, frame_id, edge_id, p*, t*, a*, b*)`: corner, edge direction and the directions
    along both faces. Points meet the frames in cells; a coarse grid of radii is followed by a
    finer one around its best, both as sums.
    """
    frames = stage(frames, _a=vec("a") - vec("t") * vec("a").dot(vec("t")), _b=vec("b") - vec("t") * vec("b").dot(vec("t")))
    frames = stage(frames, _u=vec("_a").unit(), _v=vec("_b").unit())
    frames = stage(frames, _w=vec("t").cross(vec("_u")))
    # The second face must lie on the positive side of the first.
    side = F.when(vec("_v").dot(vec("_w")) >= 0, 1.0).otherwise(-1.0)
    frames = stage(frames, _x=vec("_w") * side).withColumn("opening", F.acos(clamp(vec("_u").dot(vec("_v")), -1.0, 1.0)))
    frames = cut(frames.filter((F.col("opening") > 5 * pi / 180) & (F.col("opening") < 170 * pi / 180)))
    balls = frames.select("scan_id", F.col("frame_id").alias("q_id"), *vec("p").named(), F.lit(reach).alias("radius"))
    t = points.select("scan_id", F.col("point_id").alias("t_id"), "x", "y", "z")
    met = within_balls(balls, t, 2 * reach).select("scan_id", F.col("q_id").alias("frame_id"), "t_id").join(t, ["scan_id", "t_id"]).join(frames, ["scan_id", "frame_id"])
    d = vec() - vec("p")
    local = met.filter(F.abs(d.dot(vec("t"))) < SLAB).select(
        "scan_id", "edge_id", "frame_id", "opening", d.dot(vec("_u")).alias("s"), d.dot(vec("_x")).alias("t"))
    key = ["scan_id", "edge_id", "frame_id"]
    enough = local.groupBy(*key).agg(F.count("*").alias("points")).filter(F.col("points") >= MIN_SECTION_POINTS)
    local = cut(local.join(enough, key))
    cap = max(4.0 * noise, 0.08)
    largest = 0.9 * reach * F.tan(F.col("opening") / 2)

    def best(rows: DataFrame, radii: Column) -> DataFrame:
        tried = rows.withColumn("radius", F.explode(radii))
        tried = tried.withColumn("_d", F.least(_corner_distance(F.col("radius")), F.lit(cap)))
        cost = tried.groupBy(*key, "radius").agg(F.sum(F.col("_d") * F.col("_d")).alias("_c"), F.max("points").alias("points"))
        return cost.groupBy(*key).agg(F.min_by("radius", F.struct("_c", "radius")).alias("radius"), F.min("_c").alias("_c"), F.max("points").alias("points"))

    step = largest / (RADIUS_STEPS - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(RADIUS_STEPS - 1)), lambda k: k * step)
    coarse = cut(best(local, grid).select(*key, F.col("radius").alias("_r")))
    low, high = F.greatest(F.col("_r") - step, F.lit(0.0)), F.least(F.col("_r") + step, largest)
    fine = F.transform(F.sequence(F.lit(0), F.lit(FINE_STEPS - 1)), lambda k: low + (high - low) * k / (FINE_STEPS - 1))
    result = best(local.join(coarse, key), fine)
    return result.select(*key, "radius", F.sqrt(F.col("_c") / F.col("points")).alias("rms"), "points")
