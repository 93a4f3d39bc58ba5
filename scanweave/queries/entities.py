"""Relations and snaps of plane entities, hulls, breakpoints, Monte Carlo, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.fixtures import scan_name
from scanweave.functions.vec import r6
from scanweave.operators import entities as en
from scanweave.plans.intake import commit_import
from scanweave.registry import query

D = "::DOUBLE"
LINES = {"lines": f"SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS k, (c_custkey * 7919 % 3141) / 1000{D} + 0.0003{D} AS angle FROM customer".replace("/ 1000::DOUBLE", "/ 1000.0::DOUBLE")}


def lines(t):
    k = F.col("c_custkey")
    return t.read("customer").select(scan_name(k).alias("scan_id"), k.alias("entity_id"), (k * 7919 % 3141 / 1000.0 + 0.0003).alias("angle"))


@query("m21_axis_relations", sql("""SELECT scan_id, CASE WHEN least(angle, pi() - angle) < pi() / 180 THEN 'horizontal' ELSE 'vertical' END AS kind, k AS a FROM lines
    WHERE least(angle, pi() - angle) < pi() / 180 OR abs(angle - pi() / 2) < pi() / 180""", **LINES))
def _(t):
    return en.axis_relations(lines(t))


@query("m21_parallel_chains", sql("""SELECT scan_id, 'parallel' AS kind, k AS a, b FROM (SELECT *, lead(k) OVER w AS b, lead(angle) OVER w AS nxt FROM lines
    WHERE NOT (least(angle, pi() - angle) < pi() / 180 OR abs(angle - pi() / 2) < pi() / 180) WINDOW w AS (PARTITION BY scan_id ORDER BY angle, k)) WHERE nxt - angle < pi() / 180""", **LINES))
def _(t):
    return en.direction_relations(lines(t))


ROUNDS = {"rounds": f"SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS k, (c_custkey * 37 % 53) * 0.041{D} AS cx, (c_custkey * 53 % 71) * 0.053{D} AS cy, 2.0{D} + (c_custkey % 400) * 0.0123{D} AS radius FROM customer"}


def rounds(t):
    k = F.col("c_custkey")
    return t.read("customer").select(scan_name(k).alias("scan_id"), k.alias("entity_id"), (k * 37 % 53 * 0.041).alias("cx"), (k * 53 % 71 * 0.053).alias("cy"), (k % 400 * 0.0123 + 2).alias("radius"))


@query("m21_concentric", sql(f"""SELECT x.scan_id, 'concentric' AS kind, x.k AS a, y.k AS b FROM rounds x JOIN rounds y ON x.scan_id = y.scan_id AND x.k < y.k
    AND sqrt((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2) < 0.1501{D}""", **ROUNDS))
def _(t):
    return en.concentric(rounds(t), 0.1501)


@query("m21_tangents", sql(f"""SELECT scan_id, 'tangent' AS kind, 2 * k AS a, 2 * k + 1 AS b FROM rounds WHERE abs(abs(cx * cos(0.4{D}) + cy * sin(0.4{D}) - 9.0{D}) - radius) <= 0.2503{D}""", **ROUNDS))
def _(t):
    n = F.lit(None).cast("double")
    r_ = rounds(t)
    line = r_.select("scan_id", F.col("entity_id").alias("point_id"), (F.col("entity_id") * 2).alias("entity_id"), F.lit("line").alias("kind"), F.lit(0.4).alias("angle"), F.lit(9.0).alias("offset"), n.alias("cx"), n.alias("cy"), n.alias("radius"))
    arc = r_.select("scan_id", F.col("entity_id").alias("point_id"), (F.col("entity_id") * 2 + 1).alias("entity_id"), F.lit("arc").alias("kind"), n.alias("angle"), n.alias("offset"), "cx", "cy", "radius")
    return en.tangents(line.unionByName(arc), 0.2503)


@query("m22_radius_snaps", sql(f"""SELECT scan_id, k AS entity_id, {r('radius')} AS measured, {r('round_even(radius / f, 0) * f')} AS value, f AS step FROM (SELECT *, list_filter([5.0, 1.0, 0.5, 0.25, 0.1, 0.05]::DOUBLE[],
    lambda g: abs(radius - round_even(radius / g, 0) * g) <= 0.0061{D})[1] AS f FROM rounds) WHERE f IS NOT NULL""", **ROUNDS))
def _(t):
    s = en.value_snaps(rounds(t).withColumn("u", F.lit(0.0061) / 3), "radius", "u")
    return s.withColumns({"measured": r6(F.col("measured")), "value": r6(F.col("value"))})


@query("w13_refine_breakpoints")
def _(t):
    b = t.polylines.filter("pos % 40 = 20").select("scan_id", "chain_id", (F.col("pos") - 20).cast("int").alias("start"), F.col("pos").alias("split"), (F.col("pos") + 19).cast("int").alias("stop"))
    return en.refine_breakpoints(t.polylines, b)


@query("a45_convex_hulls", sql(f"""SELECT scan_id, {r('min(u)')} AS left_, {r('max(u)')} AS right_, {r('min(v)')} AS low, {r('max(v)')} AS high FROM loops GROUP BY scan_id"""))
def _(t):
    h = en.convex_hulls(t.loops, ["scan_id"])
    return h.groupBy("scan_id").agg(r6(F.min("u")).alias("left_"), r6(F.max("u")).alias("right_"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"))


@query("j25_outside_footprint", sql("SELECT scan_id, 0.0::DOUBLE AS share FROM loops GROUP BY scan_id"))
def _(t):
    return en.beyond_hull(t.loops, en.convex_hulls(t.loops, ["scan_id"]), ["scan_id"], 1e-9).select("scan_id", "share")


@query("a42_measurement_sigma")
def _(t):
    from scanweave.queries.scalars import item_pairs, items
    i = items(t).withColumns({"tilt_sigma": F.lit(0.001), "shift_sigma": F.lit(0.01), "size_sigma": F.lit(0.01)})
    return en.measurement_sigma(i, item_pairs(t))


@query("m28_import", sql("""SELECT scan_id, count(*) FILTER (face_id % 89 = 0) AS degenerate_faces, count(*) FILTER (face_id % 97 = 0) AS duplicate_faces, count(*) FILTER (face_id % 31 = 0) AS flipped_faces, 0.15::DOUBLE AS tolerance
    FROM tiled_faces GROUP BY scan_id"""))
def _(t):
    scans = t.vertices.select("scan_id").distinct()
    units, noise = scans.withColumn("unit", F.lit("cm")), scans.withColumn("noise", F.lit(0.05))
    done = commit_import(t.vertices, t.dirty_faces, units, noise)
    return done.counts.select("scan_id", "degenerate_faces", "duplicate_faces", "flipped_faces", "tolerance")
