"""Growth, distances, labels and smoothing on face and vertex graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6, vec
from scanweave.operators import graph, loops, mesh, segmentation as seg
from scanweave.operators.repair import placed_faces
from scanweave.registry import query
from scanweave.session import cut

D = "::DOUBLE"


def links(t):
    return mesh.neighbours(mesh.face_pairs(t.faces))


_REC = lambda seeds, rings, allow="true": f"""WITH RECURSIVE X, walk AS (SELECT scan_id, face_id, 0 AS ring FROM faces WHERE {seeds}
    UNION SELECT l.scan_id, l.other, ring + 1 FROM walk w JOIN links l ON l.face_id = w.face_id WHERE ring < {rings} AND ({allow}))
    SELECT scan_id, face_id, min(ring) AS ring FROM walk GROUP BY ALL"""


def recursive(body: str) -> str:
    """A statement with one recursive table, the fixture tables in front of it."""
    tables = sql("SELECT * FROM faces JOIN links USING (scan_id)").rsplit("\n", 1)[0]
    return tables.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body.replace("WITH RECURSIVE X, ", "")


@query("g04_grow_rings", recursive(_REC("face_id % 500 = 0", 4)))
def _(t):
    return graph.grow(t.faces.filter("face_id % 500 = 0"), links(t), 4)


@query("g04_grow_allowed", recursive(_REC("face_id % 500 = 0", 6, "l.other % 3 <> 1")))
def _(t):
    allowed = t.faces.filter("face_id % 3 <> 1").select("scan_id", "face_id")
    return graph.grow(t.faces.filter("face_id % 500 = 0"), links(t), 6, allowed)


@query("g05_ring_distance", recursive(_REC("face_id % 37 = 0", 60)))
def _(t):
    return graph.grow(t.faces.filter("face_id % 37 = 0"), links(t))


SMOOTH = {"same": f"""SELECT p.scan_id, fa, fb FROM pairs p JOIN normals a ON a.face_id = fa JOIN normals b ON b.face_id = fb
    WHERE a.nx * b.nx + a.ny * b.ny + a.nz * b.nz > cos(radians(3.5{D}))"""}


@query("g07_smooth_pairs", sql("SELECT scan_id, fa, fb FROM same", **SMOOTH))
def _(t):
    n = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[])).select("scan_id", "face_id", "nx", "ny", "nz")
    return seg.smooth_pairs(mesh.face_pairs(t.faces), n, 3.5).select("scan_id", "fa", "fb")


@query("g07_grow_smooth")
def _(t):
    n = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[])).select("scan_id", "face_id", "nx", "ny", "nz")
    return seg.grow_components(t.faces.filter("face_id % 500 = 0"), t.faces, seg.smooth_pairs(mesh.face_pairs(t.faces), n, 3.5))


@query("g07_grow_normal")
def _(t):
    n = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[])).select("scan_id", "face_id", "nx", "ny", "nz")
    return seg.grow_normal(t.faces.filter("face_id % 1000 = 0"), mesh.face_pairs(t.faces), n, 2.0)


FILL = {"cand": """SELECT l.scan_id, l.face_id, b.label, n.nx * m.nx + n.ny * m.ny + n.nz * m.nz AS dot FROM links l JOIN region_labels a ON a.face_id = l.face_id AND a.label = 0
    JOIN region_labels b ON b.face_id = l.other AND b.label > 0 JOIN normals n ON n.face_id = l.face_id JOIN normals m ON m.face_id = l.other"""}


@query("g09_fill_one_wave", sql("""SELECT scan_id, face_id, coalesce(c.label, l.label) AS label FROM region_labels l LEFT JOIN (SELECT scan_id, face_id, label FROM cand
    QUALIFY row_number() OVER (PARTITION BY scan_id, face_id ORDER BY dot DESC, label) = 1) c USING (scan_id, face_id)""", **FILL))
def _(t):
    n = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[])).select("scan_id", "face_id", "nx", "ny", "nz")
    return seg.fill_wave(t.labels, links(t), n)


RELAX = {"prims": f"SELECT DISTINCT scan_id, label, label % 7 * 0.013{D} + 0.01{D} AS h FROM region_labels WHERE label > 0",
    "opts": """SELECT l.scan_id, l.face_id, b.label FROM links l JOIN region_labels b ON b.face_id = l.other WHERE b.label > 0
        UNION SELECT scan_id, face_id, label FROM region_labels WHERE label > 0"""}


@query("g10_relax_one_wave", sql("""SELECT l.scan_id, l.face_id, CASE WHEN l.label = 0 THEN 0 ELSE b.label END AS label FROM region_labels l LEFT JOIN (SELECT o.scan_id, o.face_id, o.label FROM opts o JOIN prims p USING (scan_id, label)
    JOIN geo g USING (scan_id, face_id) JOIN region_labels own USING (scan_id, face_id) QUALIFY row_number() OVER (PARTITION BY o.scan_id, o.face_id
    ORDER BY abs(gz - h), CASE WHEN o.label = own.label THEN 0 ELSE 1 END, o.label) = 1) b USING (scan_id, face_id)""", **RELAX))
def _(t):
    g = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[])).select("scan_id", "face_id", "gx", "gy", "gz")
    label = F.col("label")
    prims = t.labels.filter("label > 0").select("scan_id", "label").distinct().select(
        "scan_id", "label", F.lit("plane").alias("kind"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), (label % 7 * 0.013 + 0.01).alias("oz"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("minor_radius"), F.lit(0.0).alias("half_angle"))
    return seg.relax_wave(t.labels, links(t), g, prims)


TAUBIN = {"nb": """SELECT scan_id, lo AS vertex_id, hi AS other FROM edges UNION ALL SELECT scan_id, hi, lo FROM edges""",
    "m1": f"""SELECT v.scan_id, v.vertex_id, {', '.join(f"v.{c} + 0.5{D} * (coalesce(avg(o.{c}), 0) - v.{c}) AS {c}" for c in 'xyz')} FROM vertices v LEFT JOIN nb USING (scan_id, vertex_id)
        LEFT JOIN vertices o ON o.vertex_id = nb.other GROUP BY v.scan_id, v.vertex_id, v.x, v.y, v.z""",
    "m2": f"""SELECT v.scan_id, v.vertex_id, {', '.join(f"v.{c} - 0.53{D} * (coalesce(avg(o.{c}), 0) - v.{c}) AS {c}" for c in 'xyz')} FROM m1 v LEFT JOIN nb USING (scan_id, vertex_id)
        LEFT JOIN m1 o ON o.vertex_id = nb.other GROUP BY v.scan_id, v.vertex_id, v.x, v.y, v.z"""}


# Coordinates have few decimals; the shift keeps their means off the rounding edges.
SHIFT = 0.0000000271828


@query("g14_taubin", sql(f"SELECT scan_id, vertex_id, {', '.join(f'{r(f"{c} + {SHIFT:.13f}{D}", 7)} AS {c}' for c in 'xyz')} FROM m2", **TAUBIN))
def _(t):
    s = loops.taubin(t.vertices, t.faces, 1)
    return s.select("scan_id", "vertex_id", *[r6(F.col(c) + SHIFT, 7).alias(c) for c in "xyz"])


@query("g15_boundary_loops", sql("""SELECT DISTINCT h.scan_id, min(src) OVER (PARTITION BY tile) AS loop_id, src AS vertex_id FROM half_edges h JOIN edges e ON e.lo = least(src, dst) AND e.hi = greatest(src, dst)
    AND valence = 1 JOIN tiled_faces t USING (face_id)"""))
def _(t):
    return loops.boundary_loops(t.faces).select("scan_id", "loop_id", "vertex_id")


@query("g15_loop_order", sql("""SELECT h.scan_id, h.src AS vertex_id, h.dst AS next_id FROM half_edges h JOIN edges e ON e.lo = least(src, dst) AND e.hi = greatest(src, dst) WHERE valence = 1"""))
def _(t):
    order = loops.boundary_loops(t.faces)
    nxt = order.select("scan_id", "loop_id", (F.col("pos") - 1).alias("pos"), F.col("vertex_id").alias("next_id"))
    first = order.filter("pos = 0").select("scan_id", "loop_id", F.col("vertex_id").alias("first_id"))
    return order.join(nxt, ["scan_id", "loop_id", "pos"], "left").join(first, ["scan_id", "loop_id"]).select(
        "scan_id", "vertex_id", F.coalesce("next_id", "first_id").alias("next_id"))


@query("g16_filled_loops", sql("""SELECT scan_id, tile_min AS loop_id, edges, perimeter <= 37.5 AS filled FROM (SELECT h.scan_id, min(src) AS tile_min, count(*) AS edges,
    sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS perimeter FROM half_edges h JOIN edges e ON e.lo = least(src, dst) AND e.hi = greatest(src, dst) AND valence = 1
    JOIN tiled_faces t USING (face_id) JOIN vertices a ON a.vertex_id = src JOIN vertices b ON b.vertex_id = dst GROUP BY h.scan_id, tile)"""))
def _(t):
    return loops.fill_holes(t.vertices, t.faces, 37.5).loops.select("scan_id", "loop_id", "edges", "filled")


@query("g16_filled_mesh")
def _(t):
    return loops.fill_holes(t.vertices, t.faces, 37.5).faces.filter("synthetic AND face_id < 0").select("scan_id", "face_id", "v0", "v1", "v2")


@query("g20_vertex_fans", sql("""SELECT scan_id, vertex_id, 1 AS fans FROM (SELECT DISTINCT scan_id, src AS vertex_id FROM half_edges)"""))
def _(t):
    return loops.fan_counts(t.faces)


@query("g20_bow_ties", sql("""SELECT scan_id, src AS vertex_id, count(*) AS fans FROM half_edges WHERE face_id % 6 = 0 GROUP BY ALL"""))
def _(t):
    # Faces with id % 6 = 0 share no edges, so every face is a fan of its own at its corners.
    return loops.fan_counts(t.faces.filter("face_id % 6 = 0"))


@query("g22_profile_check", sql("""SELECT scan_id, chain_id AS profile_id, 100 - count(*) FILTER (pos % 50 = 49 AND chain_id % 3 = 0) AS entities, CASE WHEN chain_id % 3 = 0 THEN 4 ELSE 0 END AS open_ends,
    0 AS branch_points FROM polylines GROUP BY ALL"""))
def _(t):
    n = F.col("pos")
    kept = t.polylines.filter(~((n % 50 == 49) & (F.col("chain_id") % 3 == 0)))
    e = kept.select("scan_id", "chain_id", (F.col("chain_id") * 100 + n).alias("entity_id"), (F.col("chain_id") * 100 + n).alias("start"),
                    (F.col("chain_id") * 100 + (n + 1) % 100).alias("end"))
    return loops.profile_check(e.drop("chain_id")).join(e.select("scan_id", F.col("entity_id").alias("part"), F.col("chain_id")), ["scan_id", "part"]).groupBy(
        "scan_id", F.col("chain_id").alias("profile_id")).agg(*[F.sum(c).alias(c) for c in ("entities", "open_ends", "branch_points")])


@query("f08_crease_zone")
def _(t):
    tri = mesh.corners(t.vertices, t.faces, carry=["v0", "v1", "v2"])
    residual = t.vertices.select("scan_id", "vertex_id", F.pow(F.col("z") * 10, F.lit(8.0)).alias("residual"))
    area = mesh.face_geometry(tri).select("scan_id", "face_id", "area")
    return seg.crease_zone(cut(placed_faces(t.vertices, t.faces)), residual, area)


@query("g21_decimate")
def _(t):
    from scanweave.plans.decimate import decimate
    return decimate(t.vertices, t.faces, 8.0)[1].select("scan_id", "face_id", "v0", "v1", "v2")
