"""Measurements between planes, axes and points given as pairs of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec

# Fixed value.
PARALLEL_DEG = 0.5


def relation() -> tuple[Column, Column, Column, Column]:
    """Distance, what it is, angle (degrees) and parallel flag of the items `…_a`, `…_b`."""
    ka, kb = F.col("item_a"), F.col("item_b")
    pa, pb, da, db = vec("o", "_a"), vec("o", "_b"), vec("n", "_a"), vec("n", "_b")
    gap = pb - pa
    cosine = F.least(F.abs(da.dot(db)), F.lit(1.0))
    between = F.degrees(F.acos(cosine))
    to_line = lambda offset, d: offset.cross(d).norm()

    def from_point(other: Column, d: V) -> Column:
        return F.when(other == "plane", F.abs(gap.dot(d))).when(other == "axis", to_line(gap, d)).otherwise(gap.norm())

    point = (ka == "point") | (kb == "point")
    planes, axes = (ka == "plane") & (kb == "plane"), (ka == "axis") & (kb == "axis")
    angle = F.when(~point, F.when(planes | axes, between).otherwise(90 - between))
    parallel = F.coalesce(angle < PARALLEL_DEG, F.lit(False))
    normal = (da + db * F.signum(da.dot(db))).unit()
    across = da.cross(db)
    plane_normal = V(*[F.when(ka == "plane", a).otherwise(b) for a, b in zip(da, db)])
    distance = (
        F.when(ka == "point", from_point(kb, db)).when(kb == "point", from_point(ka, da))
        .when(planes, F.when(parallel, F.abs(gap.dot(normal))))
        .when(axes & parallel, to_line(gap, da))
        .when(axes, F.abs(gap.dot(across)) / F.greatest(across.norm(), F.lit(1e-300)))
        .when(parallel, F.abs(gap.dot(plane_normal)))
    )
    what = F.when(point, "point").when(parallel, "parallel").when(axes, "shortest")
    return distance, what, angle, parallel


def measure_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs(scan_id, a, b)` measured between `items(scan_id, item_id, item, o*, n*, diameter)`.

    The pairs are the input, so the work is one row per wanted measurement.
    """
    columns = ["item", *[f"{c}{n}" for c in "on" for n in "xyz"], "diameter"]
    side = lambda s: items.select("scan_id", F.col("item_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    joined = pairs.join(side("a"), ["scan_id", "a"]).join(side("b"), ["scan_id", "b"])
    distance, what, angle, parallel = relation()
    return joined.select(
        "scan_id", "a", "b", distance.alias("distance"), what.alias("distance_kind"), angle.alias("angle_deg"),
        parallel.alias("parallel"), F.col("diameter_a"), F.col("diameter_b"),
    )
