"""Plane searches: points in polygons, nearest entities in a band, distances to polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.outlines import segment_distance
from scanweave.functions.vec import hypot
from scanweave.session import cut, dealt


def _span(low: Column, high: Column, cell) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def points_in_polygons(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """`(scan_id, polygon_id, point_id)` by the even-odd rule.

    `points(scan_id, point_id, u, v)`, `edges(scan_id, polygon_id, x0, y0, x1, y1)`. Points first
    meet the polygons whose box covers their cell, then only the edges of that polygon in
    their own row of cells.
    """
    edges = dealt(edges, "scan_id", "polygon_id")
    box = edges.groupBy("scan_id", "polygon_id").agg(
        *[f(g(f"{c}0", f"{c}1")).alias(f"{n}{c}") for c in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))]
    )
    cells = box.withColumn("_i", _span(F.col("lox"), F.col("hix"), cell)).withColumn("_j", _span(F.col("loy"), F.col("hiy"), cell))
    placed = points.withColumns({"_i": F.floor(F.col("u") / cell), "_j": F.floor(F.col("v") / cell)})
    near = placed.join(cells.hint("merge"), ["scan_id", "_i", "_j"]).filter("u BETWEEN lox AND hix AND v BETWEEN loy AND hiy").select(
        "scan_id", "polygon_id", "point_id", "u", "v", "_j"
    )
    rows = edges.filter("y0 <> y1").withColumn("_j", _span(F.least("y0", "y1"), F.greatest("y0", "y1"), cell))
    u, v, x0, y0, x1, y1 = (F.col(c) for c in ("u", "v", "x0", "y0", "x1", "y1"))
    crossing = ((y0 > v) != (y1 > v)) & (u < (x0 - x1) * (v - y1) / (y0 - y1) + x1)
    met = near.join(rows.hint("merge"), ["scan_id", "polygon_id", "_j"]).filter(crossing)
    # A point has one row of cells: grouping by the join key too needs no new exchange.
    odd = met.groupBy("scan_id", "polygon_id", "_j", "point_id").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return odd.select("scan_id", "polygon_id", "point_id")


def smallest_enclosing(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """The enclosing polygon of least area per point, and how many polygons enclose it."""
    area = edges.groupBy("scan_id", "polygon_id").agg(
        F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area")
    )
    inside = points_in_polygons(points, edges, cell).join(area, ["scan_id", "polygon_id"])
    # Areas of equal outlines differ by rounding, so ties go by the rounded area.
    return inside.groupBy("scan_id", "point_id").agg(
        F.min_by("polygon_id", F.struct(F.round("area", 6), "polygon_id")).alias("polygon_id"), F.count("*").alias("depth")
    )


def _segment_cells(segments: DataFrame, cell, reach) -> DataFrame:
    """Segments repeated for the cells within reach, column by column along their x range."""
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    df = segments.withColumn("_i", _span(low - reach, high + reach, cell))
    dx = F.col("x1") - F.col("x0")
    slope = (F.col("y1") - F.col("y0")) / F.when(dx == 0, 1.0).otherwise(dx)
    at = lambda x: F.col("y0") + slope * (F.least(F.greatest(x, low), high) - F.col("x0"))
    a, b = at(F.col("_i") * cell - reach), at((F.col("_i") + 1) * cell + reach)
    bottom = F.when(dx == 0, F.least("y0", "y1")).otherwise(F.least(a, b))
    top = F.when(dx == 0, F.greatest("y0", "y1")).otherwise(F.greatest(a, b))
    return df.withColumn("_j", _span(bottom - reach, top + reach, cell))


def assign_points(points: DataFrame, entities: DataFrame, band: float) -> DataFrame:
    """Nearest line entity `(entity_id, x0, y0, x1, y1)` of every point within a band."""
    cell = 2.0 * band
    placed = points.withColumns({"_i": F.floor(F.col("u") / cell), "_j": F.floor(F.col("v") / cell)})
    met = placed.join(_segment_cells(dealt(entities, "scan_id", "entity_id"), cell, band).hint("merge"), ["scan_id", "_i", "_j"])
    d = segment_distance(*[F.col(c) for c in ("u", "v", "x0", "y0", "x1", "y1")])
    best = met.select("scan_id", "point_id", F.struct(d.alias("d"), "entity_id").alias("_b")).groupBy("scan_id", "point_id").agg(F.min("_b").alias("_b"))
    return best.select("scan_id", "point_id", "_b.*").filter(F.col("d") <= band)


def entity_fits(assigned: DataFrame, tolerance: float) -> DataFrame:
    """Fit quality per entity: points, largest and rms distance, share within, 95 % verdict."""
    within = F.avg((F.col("d") <= tolerance).cast("double"))
    return assigned.groupBy("scan_id", "entity_id").agg(
        F.count("*").alias("points"), F.max("d").alias("max_d"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), within.alias("share"),
    ).withColumn("passed", F.col("share") >= 0.95)


def nearest_within(queries: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Nearest point of every query `(scan_id, q_id, u, v)` within `reach`; absent beyond it."""
    q = dealt(queries, "scan_id", "q_id").select("scan_id", "q_id", F.col("u").alias("qu"), F.col("v").alias("qv"))
    q = q.withColumn("_i", _span(F.col("qu") - reach, F.col("qu") + reach, 2 * reach)).withColumn("_j", _span(F.col("qv") - reach, F.col("qv") + reach, 2 * reach))
    placed = points.select("scan_id", "point_id", "u", "v", F.floor(F.col("u") / (2 * reach)).alias("_i"), F.floor(F.col("v") / (2 * reach)).alias("_j"))
    d = hypot(F.col("qu") - F.col("u"), F.col("qv") - F.col("v"))
    met = q.hint("merge").join(placed, ["scan_id", "_i", "_j"]).select("scan_id", "q_id", F.struct(d.alias("dist"), "point_id").alias("_b"))
    return met.groupBy("scan_id", "q_id").agg(F.min("_b").alias("_b")).select("scan_id", "q_id", "_b.*").filter(F.col("dist") <= reach)


def polyline_distance(points: DataFrame, polyline: DataFrame, keys: list[str], rounds: int = 32) -> DataFrame:
    """Distance of points to the closed polyline with the same key.

    A hit is final when it is within one cell; the other points repeat with doubled cells.
    The first cell is the mean edge length of the polyline.
    """
    from scanweave.operators.polylines import windowed

    seg = windowed(polyline, 1, {"x1": lambda w: F.lead("u").over(w), "y1": lambda w: F.lead("v").over(w)}, keys=keys, closed=True)
    seg = seg.select(*keys, F.col("u").alias("x0"), F.col("v").alias("y0"), "x1", "y1")
    size = seg.groupBy(*keys).agg(F.greatest(F.avg(hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(1e-9)).alias("_h"))
    seg, rest = cut(seg.join(size, keys)), cut(points.join(size, keys))
    done: DataFrame | None = None
    for k in range(rounds):
        h = F.col("_h") * float(2**k)
        cells = _segment_cells(seg, h, h).drop("_h")
        placed = rest.withColumns({"_i": F.floor(F.col("u") / h), "_j": F.floor(F.col("v") / h)})
        d = segment_distance(*[F.col(c) for c in ("u", "v", "x0", "y0", "x1", "y1")])
        met = placed.join(cells, [*keys, "_i", "_j"]).groupBy(*keys, "point_id", "_h").agg(F.min(d).alias("d"))
        found = cut(met.filter(F.col("d") <= h).select(*keys, "point_id", "d"))
        done = found if done is None else done.unionByName(found)
        rest = cut(rest.join(found.select(*keys, "point_id"), [*keys, "point_id"], "left_anti"))
        if rest.isEmpty():
            return done
    raise RuntimeError("points too far from their polyline")
