"""Sections and rotational profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions import frames
from scanweave.functions.vec import lit, r6, vec
from scanweave.operators import mesh, sections as sec
from scanweave.registry import query

D = "::DOUBLE"


def tri(t):
    return mesh.corners(t.vertices, t.faces, carry=["v0", "v1", "v2"])


def box_tri(t):
    return mesh.corners(t.box_vertices, t.outward_faces, carry=["v0", "v1", "v2"])


CUTS = {"cuts": """SELECT g.scan_id, s.k AS section_id, face_id, list_sort([CASE WHEN (ax > h) <> (bx > h) THEN ay + (by_ - ay) * (h - ax) / (bx - ax) END,
    CASE WHEN (bx > h) <> (cx > h) THEN by_ + (cy - by_) * (h - bx) / (cx - bx) END, CASE WHEN (cx > h) <> (ax > h) THEN cy + (ay - cy) * (h - cx) / (ax - cx) END]) AS ys
    FROM tri g JOIN (SELECT k, 0.37::DOUBLE + k * 0.75::DOUBLE AS h FROM range(0, 140) t(k)) s ON least(ax, bx, cx) < h AND greatest(ax, bx, cx) > h"""}


@query("m23_plane_segments", sql(f"SELECT scan_id, section_id, face_id, {r('list_min(ys)')} AS y0, {r('list_max(ys)')} AS y1 FROM cuts", **CUTS))
def _(t):
    s = sec.stack_segments(tri(t), lit(1, 0, 0), 0.37, 0.75, 140)
    return s.select("scan_id", "section_id", "face_id", r6(F.least("sy", "ey")).alias("y0"), r6(F.greatest("sy", "ey")).alias("y1"))


@query("m23_single_planes", sql(f"""SELECT scan_id, face_id, count(*) AS n FROM geo JOIN (SELECT 'scan_' || r_regionkey AS scan_id, r_regionkey * 7 + 20.13{D} AS h FROM region) USING (scan_id)
    WHERE least(0.6{D} * ax + 0.8{D} * ay, 0.6{D} * bx + 0.8{D} * by_, 0.6{D} * cx + 0.8{D} * cy) <= h AND greatest(0.6{D} * ax + 0.8{D} * ay, 0.6{D} * bx + 0.8{D} * by_, 0.6{D} * cx + 0.8{D} * cy) > h GROUP BY ALL"""))
def _(t):
    k = F.col("r_regionkey")
    h = k * 7 + 20.13
    planes = t.read("region").select(F.concat(F.lit("scan_"), k.cast("string")).alias("scan_id"), F.lit(0).alias("section_id"), (h * 0.6).alias("ox"), (h * 0.8).alias("oy"),
                                     F.lit(0.0).alias("oz"), F.lit(0.6).alias("nx"), F.lit(0.8).alias("ny"), F.lit(0.0).alias("nz"))
    return sec.plane_segments(tri(t), planes).groupBy("scan_id", "face_id").agg(F.count("*").alias("n"))


@query("g18_open_chains", sql("""SELECT scan_id, section_id, min(face_id) AS chain_id, false AS closed, count(*) + 1 AS points FROM cuts JOIN tiled_faces USING (scan_id, face_id) GROUP BY scan_id, section_id, tile""", **CUTS))
def _(t):
    chains, _ = sec.chain_segments(sec.stack_segments(tri(t), lit(1, 0, 0), 0.37, 0.75, 140))
    return chains


@query("g18_closed_chains", sql(f"""SELECT scan_id, k AS section_id, body, 8 AS points, {r('dx * dy', 5)} AS area FROM boxes, range(0, 5) t(k) WHERE 0.5 + k < dz"""))
def _(t):
    chains, points = sec.chain_segments(sec.stack_segments(box_tri(t), lit(0, 0, 1), 0.5, 1.0, 5))
    area = sec.section_areas(points, lit(0, 0, 1))
    return chains.filter("closed").join(area, ["scan_id", "section_id", "chain_id"]).select(
        "scan_id", "section_id", F.floor(F.col("chain_id") / 12).alias("body"), "points", r6(F.abs("area"), 5).alias("area"))


@query("m25_section_stack", sql(f"""SELECT scan_id, k AS section_id, count(*) AS loops, {r('sum(dx * dy)', 4)} AS area FROM boxes, range(0, 5) t(k) WHERE 0.5 + k < dz GROUP BY ALL"""))
def _(t):
    _, points = sec.chain_segments(sec.stack_segments(box_tri(t), lit(0, 0, 1), 0.5, 1.0, 5))
    return sec.section_areas(points, lit(0, 0, 1)).groupBy("scan_id", "section_id").agg(F.count("*").alias("loops"), r6(F.sum(F.abs("area")), 4).alias("area"))


@query("f13_support_points", sql(
    f"""SELECT scan_id, point_id, count(*) AS n FROM patch_points WHERE abs(z - 2.0{D}) <= 0.4{D} AND abs(nz) <= 0.1{D} GROUP BY ALL"""))
def _(t):
    rows = sec.support_points(t.patch_points, lit(0, 0, 2), lit(0, 0, 1))
    return rows.groupBy("scan_id", "point_id").agg(F.count("*").alias("n"))


@query("t03_every_nth", sql("""SELECT scan_id, vertex_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY vertex_id) - 1 AS k, greatest(count(*) OVER (PARTITION BY scan_id) // 700, 1) AS s FROM vertices)
    WHERE k % s = 0"""))
def _(t):
    return sec.every_nth(t.vertices, "vertex_id", 700).select("scan_id", "vertex_id")


@query("m24_half_plane_runs", sql(f"""SELECT scan_id, chain_id, count(*) AS runs, sum(n)::BIGINT AS points FROM (SELECT scan_id, chain_id, grp, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY scan_id, chain_id
    ORDER BY pos) AS grp FROM polylines WHERE v - 1.0003{D} >= 0) GROUP BY ALL) GROUP BY ALL"""))
def _(t):
    p = t.polylines.select("scan_id", "chain_id", F.lit(False).alias("closed"), "pos", "u", (F.col("v") - 1.0003).alias("v"))
    runs = sec.half_plane_runs(p)
    own = runs.filter("pos = floor(pos)")
    return own.groupBy("scan_id", "chain_id").agg(F.count_distinct("run").alias("runs"), F.count("*").alias("points"))


@query("m24_axis_crossings", sql(f"""SELECT scan_id, chain_id, count(*) AS crossings, {r('sum(u + (v - 1.0003) / (v - v1) * (u1 - u))', 4)} AS total FROM (SELECT *, lead(u) OVER w AS u1, lead(v) OVER w AS v1 FROM polylines
    WINDOW w AS (PARTITION BY scan_id, chain_id ORDER BY pos)) WHERE (v >= 1.0003{D}) <> (v1 >= 1.0003{D}) GROUP BY ALL"""))
def _(t):
    p = t.polylines.select("scan_id", "chain_id", F.lit(False).alias("closed"), "pos", "u", (F.col("v") - 1.0003).alias("v"))
    ends = sec.half_plane_runs(p).filter("pos <> floor(pos)")
    return ends.groupBy("scan_id", "chain_id").agg(F.count("*").alias("crossings"), r6(F.sum("u"), 4).alias("total"))


@query("m24_folded_support", sql(f"""SELECT scan_id, point_id, {r('z')} AS along, {r('sqrt(x * x + y * y)')} AS radial, count(*) AS n FROM patch_points GROUP BY ALL"""))
def _(t):
    h, rho = frames.fold(vec(), lit(0, 0, 0), lit(0, 0, 1))
    return t.patch_points.select("scan_id", "point_id", r6(h).alias("along"), r6(rho).alias("radial")).groupBy("scan_id", "point_id", "along", "radial").agg(F.count("*").alias("n"))
