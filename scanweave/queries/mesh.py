"""Meshes: gather, geometry, topology, condition report, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6
from scanweave.operators import graph, mesh, repair as ops
from scanweave.plans.repair import repair
from scanweave.plans.report import boundary_loop_counts, mesh_report
from scanweave.registry import query
from scanweave.session import cut

XYZ9 = [f"{c}{a}" for c in "abc" for a in "xyz"]


@query("j01_corner_gather", sql(
    "SELECT scan_id, face_id, ax, ay, az, bx, by_ AS by, bz, cx, cy, cz FROM tri"))
def _(t):
    return mesh.corners(t.vertices, t.faces).select("scan_id", "face_id", *XYZ9)


@query("p05_face_geometry", sql(f"""SELECT scan_id, face_id, {r('nx')} AS nx, {r('ny')} AS ny, {r('nz')} AS nz,
    {r('area')} AS area, {r('gx')} AS gx, {r('gy')} AS gy, {r('gz')} AS gz FROM normals"""))
def _(t):
    g = mesh.face_geometry(mesh.corners(t.vertices, t.faces))
    return g.select("scan_id", "face_id", *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz", "area", "gx", "gy", "gz")])


@query("s06_finite_faces", sql(f"""SELECT scan_id, face_id, {r('ax')} AS ax, {r('cz')} AS cz FROM soup
    WHERE isfinite(ax) AND isfinite(cz)"""))
def _(t):
    return ops.finite_faces(t.soup).select("scan_id", "face_id", r6(F.col("ax")).alias("ax"), r6(F.col("cz")).alias("cz"))


@query("s06_dropped_counts", sql("""SELECT scan_id, count(*) - count(*) FILTER (isfinite(ax) AND isfinite(cz)) AS dropped_faces
    FROM soup GROUP BY scan_id"""))
def _(t):
    kept = ops.finite_faces(t.soup).groupBy("scan_id").agg(F.count("*").alias("kept"))
    return t.soup.groupBy("scan_id").agg(F.count("*").alias("n")).join(kept, "scan_id", "left").select(
        "scan_id", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped_faces"))


@query("j02_half_edges", sql("SELECT scan_id, face_id, slot, src, dst, least(src, dst) AS lo, greatest(src, dst) AS hi FROM half_edges"))
def _(t):
    return mesh.half_edges(t.faces)


@query("j02_face_pairs", sql("SELECT scan_id, lo, hi, fa, fb, consistent FROM pairs"))
def _(t):
    return mesh.face_pairs(t.faces).select("scan_id", "lo", "hi", "fa", "fb", "consistent")


@query("w02_edge_runs", sql("SELECT scan_id, lo, hi, valence FROM edges"))
def _(t):
    return mesh.edges(t.dirty_faces.filter("face_id < 1000000000")).select("scan_id", "lo", "hi", "valence")


@query("j03_neighbour_table", sql("""SELECT scan_id, face_id, slot, total - face_id AS other FROM e
    WHERE n = 2 AND low <> high""", e="""SELECT *, count(*) OVER edge AS n, sum(face_id) OVER edge AS total, min(src) OVER edge AS low,
        max(src) OVER edge AS high FROM half_edges WINDOW edge AS (PARTITION BY scan_id, least(src, dst), greatest(src, dst))"""))
def _(t):
    return mesh.neighbours(mesh.face_pairs(t.faces))


@query("a04_edge_valence", sql("""SELECT scan_id, count(*) AS edges, count(*) FILTER (valence = 1) AS boundary_edges,
    count(*) FILTER (valence = 2) AS manifold_edges, count(*) FILTER (valence > 2) AS non_manifold_edges,
    count(*) FILTER (valence = 2 AND directions = 1) AS inconsistent_edges FROM e GROUP BY scan_id""",
    h="""SELECT scan_id, v0 AS src, v1 AS dst FROM dirty_faces UNION ALL SELECT scan_id, v1, v2 FROM dirty_faces
        UNION ALL SELECT scan_id, v2, v0 FROM dirty_faces""",
    e="""SELECT scan_id, least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS valence,
        count(DISTINCT src) AS directions FROM h GROUP BY ALL"""))
def _(t):
    return mesh.edge_counts(t.dirty_faces)


PART_SIZES = """SELECT scan_id, tile, count(*) AS n FROM tiled_faces GROUP BY ALL"""
KEPT = """SELECT *, n >= least(greatest(100, 0.01::DOUBLE * max(n) OVER (PARTITION BY scan_id)),
    max(n) OVER (PARTITION BY scan_id)) AS keep FROM sizes"""


@query("a05_mesh_report", sql(f"""SELECT scan_id, face_count, vertex_count, false AS watertight, components AS boundary_loops, boundary_edges,
    0 AS non_manifold_edges, 0 AS inconsistent_edges, components, small_parts, 0 AS degenerate_faces, 0 AS duplicate_faces,
    synthetic_faces, {r('area', 5)} AS area, NULL::DOUBLE AS volume, {r('size_x')} AS size_x, {r('size_y')} AS size_y, {r('size_z')} AS size_z
    FROM f JOIN v USING (scan_id) JOIN p USING (scan_id) JOIN b USING (scan_id)""",
    sizes=PART_SIZES, kept=KEPT,
    f="SELECT scan_id, count(*) AS face_count, count(*) FILTER (synthetic) AS synthetic_faces, sum(area) AS area FROM normals GROUP BY scan_id",
    v="""SELECT scan_id, count(*) AS vertex_count, max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z
        FROM vertices GROUP BY scan_id""",
    p="SELECT scan_id, count(*) AS components, count(*) FILTER (NOT keep) AS small_parts FROM kept GROUP BY scan_id",
    b="SELECT scan_id, count(*) FILTER (valence = 1) AS boundary_edges FROM edges GROUP BY scan_id"))
def _(t):
    rep = mesh_report(t.vertices, t.faces)
    return rep.withColumns({c: r6(F.col(c), 5 if c == "area" else 6) for c in ("area", "size_x", "size_y", "size_z")})


@query("a05_closed_report", sql(f"""SELECT scan_id, count(*) AS components, bool_and(true) AS watertight, sum(n)::BIGINT AS face_count,
    {r('sum(a)', 4)} AS area, {r('abs(sum(v))', 4)} AS volume FROM b GROUP BY scan_id""",
    b="""SELECT scan_id, body, 12 AS n, 2 * (dx * dy + dy * dz + dx * dz) AS a,
        CASE WHEN body % 10 = 3 THEN -1 ELSE 1 END * dx * dy * dz AS v FROM boxes"""))
def _(t):
    rep = mesh_report(t.box_vertices, t.box_faces)
    return rep.select("scan_id", "components", "watertight", "face_count", r6(F.col("area"), 4).alias("area"),
                      r6(F.col("volume"), 4).alias("volume"))


@query("a06_signed_volume", sql(f"""SELECT scan_id, {r('sum(CASE WHEN body % 10 = 3 THEN -1 ELSE 1 END * dx * dy * dz)', 4)} AS volume
    FROM boxes GROUP BY scan_id"""))
def _(t):
    v = mesh.signed_volume(mesh.corners(t.box_vertices, t.box_faces), t.box_vertices)
    return v.select("scan_id", r6(F.col("volume"), 4).alias("volume"))


@query("a07_inverted_parts", sql(f"""SELECT scan_id, body, {r('-dx * dy * dz', 4)} AS volume FROM boxes WHERE body % 10 = 3"""))
def _(t):
    parts = graph.edge_parts(t.box_faces, mesh.face_pairs(t.box_faces))
    tri = mesh.corners(t.box_vertices, t.box_faces, carry=[]).join(parts, ["scan_id", "face_id"])
    return ops.inverted_parts(tri, ["scan_id", "part"]).select(
        "scan_id", F.floor(F.col("part") / 12).alias("body"), r6(F.col("volume"), 4).alias("volume"))


@query("a01_weld_vertices", sql("SELECT scan_id, vertex_id, min(vertex_id) OVER (PARTITION BY scan_id, cx, cy, cz) AS kept_id FROM cells",
    sv="""SELECT scan_id, 3 * face_id AS vertex_id, ax AS x, ay AS y, az AS z FROM tri
        UNION ALL SELECT scan_id, 3 * face_id + 1, bx, by_, bz FROM tri UNION ALL SELECT scan_id, 3 * face_id + 2, cx, cy, cz FROM tri""",
    box="""SELECT scan_id, min(x) AS lx, min(y) AS ly, min(z) AS lz,
        greatest(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 1e-12) / 1048576 AS c FROM sv GROUP BY scan_id""",
    cells="""SELECT scan_id, vertex_id, floor((x - lx) / c) AS cx, floor((y - ly) / c) AS cy, floor((z - lz) / c) AS cz
        FROM sv JOIN box USING (scan_id)"""))
def _(t):
    tri = mesh.corners(t.vertices, t.faces, carry=[])
    return ops.weld_map(ops.soup_vertices(tri)[0])


@query("a02_compact", sql("SELECT scan_id, vertex_id FROM vertices WHERE vertex_id IN (SELECT src FROM half_edges WHERE face_id % 3 <> 0)"))
def _(t):
    return mesh.used_vertices(t.vertices, t.faces.filter("face_id % 3 <> 0")).select("scan_id", "vertex_id")


@query("a02_dense_ids", sql("""SELECT scan_id, vertex_id, row_number() OVER (PARTITION BY scan_id ORDER BY vertex_id) - 1 AS dense_id FROM vertices
    WHERE vertex_id IN (SELECT src FROM half_edges WHERE face_id % 3 <> 0)"""))
def _(t):
    from scanweave.operators.ranking import dense_ids
    return dense_ids(mesh.used_vertices(t.vertices, t.faces.filter("face_id % 3 <> 0")), "vertex_id", "dense_id").select(
        "scan_id", "vertex_id", "dense_id")


@query("a03_duplicate_faces", sql("""SELECT scan_id, min(face_id) AS face_id, count(*) - 1 AS copies FROM dirty_faces
    GROUP BY scan_id, list_sort([v0, v1, v2])"""))
def _(t):
    key = F.array_sort(F.array("v0", "v1", "v2"))
    copies = t.dirty_faces.groupBy("scan_id", key.alias("k")).agg(F.min("face_id").alias("face_id"), (F.count("*") - 1).alias("copies"))
    return ops.distinct_faces(t.dirty_faces).select("scan_id", "face_id").join(copies.drop("k"), ["scan_id", "face_id"])


@query("f01_degenerate_faces", sql("SELECT scan_id, face_id + 2000000000 AS face_id FROM dirty_base WHERE face_id % 89 = 0"))
def _(t):
    return ops.degenerate_faces(t.vertices, t.dirty_faces)


@query("f02_delete_faces", sql("""SELECT 'face' AS item, scan_id, face_id AS id FROM keep
    UNION ALL SELECT 'vertex', scan_id, vertex_id FROM vertices WHERE vertex_id IN (SELECT unnest([v0, v1, v2]) FROM keep)""",
    keep="SELECT * FROM faces WHERE face_id NOT IN (SELECT face_id FROM selection)"))
def _(t):
    kept = ops.without(t.faces, t.selection)
    used = mesh.used_vertices(t.vertices, kept)
    return kept.select(F.lit("face").alias("item"), "scan_id", F.col("face_id").alias("id")).unionByName(
        used.select(F.lit("vertex").alias("item"), "scan_id", F.col("vertex_id").alias("id")))


@query("g01_edge_parts", sql("SELECT scan_id, face_id, min(face_id) OVER (PARTITION BY tile) AS part FROM tiled_faces"))
def _(t):
    return graph.edge_parts(t.faces, mesh.face_pairs(t.faces))


@query("g02_vertex_parts", sql("""SELECT scan_id, face_id, min(v0) OVER (PARTITION BY tile) AS part FROM tiled_faces"""))
def _(t):
    return graph.vertex_parts(t.faces)


@query("g03_masked_parts", sql("""SELECT scan_id, face_id, min(face_id) OVER (PARTITION BY tile, half) AS part
    FROM (SELECT *, ((face_id // 2) // 100) % 10 > 4 AS half FROM tiled_faces WHERE ((face_id // 2) // 100) % 10 <> 4)"""))
def _(t):
    kept = t.faces.filter("cast(cast(face_id / 2 as long) / 100 as long) % 10 <> 4")
    allowed = kept.select("scan_id", "face_id")
    pairs = mesh.face_pairs(t.faces)
    pairs = pairs.join(allowed.withColumnRenamed("face_id", "fa"), ["scan_id", "fa"], "left_semi").join(
        allowed.withColumnRenamed("face_id", "fb"), ["scan_id", "fb"], "left_semi")
    return graph.edge_parts(kept, pairs)


@query("f12_kept_parts", sql("SELECT scan_id, face_id FROM tiled_faces JOIN kept USING (scan_id, tile) WHERE keep", sizes=PART_SIZES, kept=KEPT))
def _(t):
    return ops.without_small_parts(t.faces).select("scan_id", "face_id")


@query("g06_fix_winding", sql("SELECT scan_id, face_id, v0, v1, v2, face_id % 31 = 0 AS flipped FROM tiled_faces"))
def _(t):
    faces = ops.distinct_faces(ops.without(t.dirty_faces, t.dirty_faces.filter("v0 = v1").select("scan_id", "face_id")))
    faces = cut(ops.placed_faces(t.vertices, faces))
    turned = ops.winding(faces, mesh.face_pairs(faces, least=["near"]))
    joined = faces.join(turned, ["scan_id", "face_id"])
    return ops.reversed_faces(joined, F.col("flip")).select("scan_id", "face_id", "v0", "v1", "v2", F.col("flip").alias("flipped"))


# A tile of the grid is open, but chance can still give it a clear negative volume.
TURNED = {
    "middle": "SELECT tile, avg(gx) AS mx, avg(gy) AS my, avg(gz) AS mz FROM geo JOIN tiled_faces USING (scan_id, face_id) GROUP BY tile",
    "share": """SELECT tile, (ax - mx) * ((by_ - my) * (cz - mz) - (bz - mz) * (cy - my)) + (ay - my) * ((bz - mz) * (cx - mx) - (bx - mx) * (cz - mz))
        + (az - mz) * ((bx - mx) * (cy - my) - (by_ - my) * (cx - mx)) AS s FROM tri JOIN tiled_faces t USING (scan_id, face_id) JOIN middle USING (tile)""",
    "turned": "SELECT tile, sum(s) < 0 AND abs(sum(s)) >= 0.2::DOUBLE * sum(abs(s)) AS over_ FROM share GROUP BY tile",
}


@query("m27_repair_counts", sql("""SELECT scan_id, count(*) AS faces, 0 AS merged_vertices, count(*) FILTER (face_id % 89 = 0) AS degenerate_faces,
    count(*) FILTER (face_id % 97 = 0) AS duplicate_faces, count(*) FILTER (face_id % 31 = 0) AS flipped_faces, 0 AS non_orientable_faces,
    count(DISTINCT tile) FILTER (over_) AS inverted_parts FROM tiled_faces JOIN turned USING (tile) GROUP BY scan_id""", **TURNED))
def _(t):
    return repair(t.vertices, t.dirty_faces).counts


@query("m27_repair_faces", sql("""SELECT scan_id, face_id, CASE WHEN over_ THEN v2 ELSE v0 END AS v0, v1, CASE WHEN over_ THEN v0 ELSE v2 END AS v2
    FROM tiled_faces JOIN turned USING (tile)""", **TURNED))
def _(t):
    return repair(t.vertices, t.dirty_faces).faces.select("scan_id", "face_id", "v0", "v1", "v2")


@query("a05_boundary_loops", sql("SELECT scan_id, count(DISTINCT tile) AS boundary_loops FROM tiled_faces GROUP BY scan_id"))
def _(t):
    return boundary_loop_counts(t.faces)


@query("a29_bounds", sql(f"""SELECT scan_id, min(x) AS min_x, min(y) AS min_y, {r('min(z)')} AS min_z, max(x) AS max_x, max(y) AS max_y,
    {r('max(z)')} AS max_z FROM vertices GROUP BY scan_id"""))
def _(t):
    b = mesh.bounds(t.vertices)
    return b.withColumns({c: r6(F.col(c)) for c in ("min_z", "max_z")})


@query("a29_block_bounds", sql(f"""SELECT scan_id, face_id // 4096 AS block, min(least(ax, bx, cx)) AS min_x, max(greatest(ax, bx, cx)) AS max_x,
    {r('min(least(az, bz, cz))')} AS min_z, {r('max(greatest(az, bz, cz))')} AS max_z FROM tri GROUP BY ALL"""))
def _(t):
    tri = mesh.corners(t.vertices, t.faces, carry=[])
    return tri.groupBy("scan_id", F.floor(F.col("face_id") / 4096).alias("block")).agg(
        F.min(F.least("ax", "bx", "cx")).alias("min_x"), F.max(F.greatest("ax", "bx", "cx")).alias("max_x"),
        r6(F.min(F.least("az", "bz", "cz"))).alias("min_z"), r6(F.max(F.greatest("az", "bz", "cz"))).alias("max_z"))


@query("a29_minimum_along", sql(f"""SELECT scan_id, {r('min((x + 2 * y + 2 * z) / 3)')} AS low,
    {r('max((x + 2 * y + 2 * z) / 3) - min((x + 2 * y + 2 * z) / 3)')} AS extent FROM vertices GROUP BY scan_id"""))
def _(t):
    along = (F.col("x") + 2 * F.col("y") + 2 * F.col("z")) / 3
    return t.vertices.groupBy("scan_id").agg(r6(F.min(along)).alias("low"), r6(F.max(along) - F.min(along)).alias("extent"))


@query("a09_vertex_normals", sql(f"""SELECT scan_id, vertex_id, {r('coalesce(sx / l, 0)')} AS nx, {r('coalesce(sy / l, 0)')} AS ny,
    {r('coalesce(sz / l, 1)')} AS nz FROM vertices LEFT JOIN (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM s) USING (scan_id, vertex_id)""",
    s="""SELECT scan_id, v AS vertex_id, sum(kx) AS sx, sum(ky) AS sy, sum(kz) AS sz
        FROM (SELECT scan_id, unnest([v0, v1, v2]) AS v, kx, ky, kz FROM geo) GROUP BY ALL"""))
def _(t):
    n = mesh.vertex_normals(t.vertices, mesh.corners(t.vertices, t.faces))
    return n.select("scan_id", "vertex_id", *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


@query("s10_every_nth_vertex", sql(f"""SELECT scan_id, vertex_id, x, y, {r('z')} AS z FROM vertices WHERE vertex_id % 10 = 0"""))
def _(t):
    n = mesh.vertex_normals(t.vertices, mesh.corners(t.vertices, t.faces))
    return n.filter("vertex_id % 10 = 0").select("scan_id", "vertex_id", "x", "y", r6(F.col("z")).alias("z"))
