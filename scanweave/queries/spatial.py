"""Nearest rows, radius joins, signed deviation, winding, rays, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sadd, scross, sdot, smul, snorm, sql, ssub, sv
from scanweave.functions.vec import V, r6, vec
from scanweave.operators import deviation_stats as ds, mesh, planar, spatial as sp
from scanweave.plans.deviation import deviation_map, near_bodies, reference_tables
from scanweave.registry import query

D = "::DOUBLE"
STATS = ["mean", "std", "rms", "min", "max", "p05", "p50", "p95", "p99_abs", "within", "above", "below"]


def geometry(t):
    return mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[]))


def points(df, id_, x="x", y="y", z="z", name="t_id"):
    return df.select("scan_id", F.col(id_).alias(name), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))


@query("a08_voxel_subsample", sql("""SELECT scan_id, min(vertex_id) AS vertex_id FROM vertices JOIN (SELECT scan_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM vertices GROUP BY scan_id)
    USING (scan_id) GROUP BY scan_id, floor((x - lx) / 2.5), floor((y - ly) / 2.5), floor((z - lz) / 0.05)""".replace("/ 0.05", "/ 2.5")))
def _(t):
    return sp.voxel_subsample(t.vertices, 2.5).select("scan_id", "vertex_id")


NEAREST = {"old_c": "SELECT scan_id, face_id, gx, gy, gz FROM geo WHERE face_id % 2 = 0",
           "new_c": f"SELECT scan_id, face_id, gx + 0.11{D} AS gx, gy - 0.07{D} AS gy, gz + 0.02{D} AS gz FROM geo WHERE face_id % 2 = 1",
           "near": """SELECT n.scan_id, n.face_id AS new_face, o.face_id AS old_face, sqrt((n.gx - o.gx) ** 2 + (n.gy - o.gy) ** 2 + (n.gz - o.gz) ** 2) AS dist FROM new_c n
            JOIN old_c o ON o.scan_id = n.scan_id QUALIFY row_number() OVER (PARTITION BY n.scan_id, n.face_id ORDER BY (n.gx - o.gx) ** 2 + (n.gy - o.gy) ** 2 + (n.gz - o.gz) ** 2, o.face_id) = 1"""}


def centroid_map(t):
    g, f = geometry(t), F.col("face_id")
    old = g.filter(f % 2 == 0)
    new = g.filter(f % 2 == 1).withColumns({"gx": F.col("gx") + 0.11, "gy": F.col("gy") - 0.07, "gz": F.col("gz") + 0.02})
    return sp.nearest(points(new, "face_id", "gx", "gy", "gz", "q_id"), points(old, "face_id", "gx", "gy", "gz"))


@query("j06_nearest_centroid_map", sql(f"SELECT scan_id, new_face, old_face, {r('dist')} AS dist FROM near", **NEAREST))
def _(t):
    return centroid_map(t).select("scan_id", F.col("q_id").alias("new_face"), F.col("t_id").alias("old_face"), r6(F.col("dist")).alias("dist"))


@query("j06_transfer_labels", sql("SELECT n.scan_id, new_face AS face_id, label FROM near n JOIN region_labels l ON l.face_id = old_face", **NEAREST))
def _(t):
    m = centroid_map(t).select("scan_id", F.col("q_id").alias("new_face"), F.col("t_id").alias("face_id"))
    return m.join(t.labels, ["scan_id", "face_id"]).select("scan_id", F.col("new_face").alias("face_id"), "label")


@query("j06_nearest_in_cloud", sql(f"""SELECT a.scan_id, a.point_id AS q_id, arg_min(b.point_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS t_id,
    {r('min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2))')} AS dist FROM cloud a JOIN cloud b ON a.scan_id = b.scan_id AND b.label % 2 = 0 WHERE a.label % 2 = 1 GROUP BY ALL"""))
def _(t):
    q, s = t.cloud.filter("label % 2 = 1"), t.cloud.filter("label % 2 = 0")
    return sp.nearest(points(q, "point_id", name="q_id"), points(s, "point_id")).withColumn("dist", r6(F.col("dist")))


@query("j07_k_nearest", sql(f"""SELECT scan_id, q_id, t_id, rank, {r('dist')} AS dist FROM (SELECT a.scan_id, a.vertex_id AS q_id, b.vertex_id AS t_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist,
    row_number() OVER (PARTITION BY a.scan_id, a.vertex_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.vertex_id) AS rank
    FROM vertices a JOIN vertices b ON a.scan_id = b.scan_id AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4) WHERE rank <= 6"""))
def _(t):
    sample = sp.voxel_subsample(t.vertices, 0.5)
    k = sp.k_nearest(points(sample, "vertex_id", name="q_id"), points(sample, "vertex_id"), 6, 1.5)
    return k.withColumn("dist", r6(F.col("dist")))


@query("j08_radius_mean", sql(f"""SELECT a.scan_id, a.vertex_id, {r('avg(b.z)', 9)} AS value FROM vertices a JOIN vertices b ON a.scan_id = b.scan_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2
    AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 2.25 GROUP BY ALL"""))
def _(t):
    p = points(t.vertices, "vertex_id")
    met = sp.within_radius(p.withColumnRenamed("t_id", "q_id"), p, 1.5)
    top = sp.closest_rows(met, 32)
    values = t.vertices.select("scan_id", F.col("vertex_id").alias("t_id"), F.col("z").alias("value"))
    return top.join(values, ["scan_id", "t_id"]).groupBy("scan_id", F.col("q_id").alias("vertex_id")).agg(r6(F.avg("value"), 9).alias("value"))


@query("j09_balls", sql("""SELECT c.scan_id, circle_id AS ball_id, face_id FROM geo g JOIN (SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS circle_id, (c_custkey * 37 % 100)::DOUBLE AS x,
    (c_custkey * 53 % 140)::DOUBLE AS y, 0.5::DOUBLE + c_custkey % 4 AS radius FROM customer) c ON c.scan_id = g.scan_id
    AND (gx - x) * (gx - x) + (gy - y) * (gy - y) + (gz - 0.05::DOUBLE) * (gz - 0.05::DOUBLE) <= radius * radius"""))
def _(t):
    from scanweave.fixtures import scan_name
    k = F.col("c_custkey")
    balls = t.read("customer").select(scan_name(k).alias("scan_id"), k.alias("q_id"), (k * 37 % 100).cast("double").alias("x"),
        (k * 53 % 140).cast("double").alias("y"), F.lit(0.05).alias("z"), (F.lit(0.5) + k % 4).alias("radius"))
    met = sp.within_balls(balls, points(geometry(t), "face_id", "gx", "gy", "gz"), 2.0)
    return met.select("scan_id", F.col("q_id").alias("ball_id"), F.col("t_id").alias("face_id"))


# ---------------------------------------------------------------- signed deviation

SDF = {"sdf": f"""SELECT scan_id, vertex_id, body, CASE WHEN greatest(a, b, c) > 0 THEN sqrt(greatest(a, 0) ** 2 + greatest(b, 0) ** 2 + greatest(c, 0) ** 2) ELSE greatest(a, b, c) END AS signed
    FROM (SELECT *, abs(x - x0 - dx / 2) - dx / 2 AS a, abs(y - y0 - dy / 2) - dy / 2 AS b, abs(z - z0 - dz / 2) - dz / 2 AS c FROM box_points)"""}
BOUND = 3.0001


def nominal_boxes(t):
    tri, normals = reference_tables(t.box_vertices, t.outward_faces)
    return tri.withColumn("nominal_face", F.floor((F.col("face_id") % 12) / 2)), normals


@query("j11_signed_closest_points", sql(f"SELECT scan_id, vertex_id, {r('signed')} AS signed FROM sdf WHERE abs(signed) <= {BOUND}{D}", **SDF))
def _(t):
    tri, normals = nominal_boxes(t)
    return sp.signed_distances(t.box_points, tri, normals, BOUND).select("scan_id", "vertex_id", r6(F.col("signed")).alias("signed"))


def nominal_planes(t):
    """The plane z = 0 under every tile as two triangles, one body per scan."""
    corner = t.grid.groupBy("scan_id", "tile").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    rows = F.array(*[F.struct((F.col("tile") * 4 + n).alias("vertex_id"), (F.col("i") + 9.0 * (n % 2)).alias("x"), (F.col("j") + 9.0 * (n // 2)).alias("y"), F.lit(0.0).alias("z")) for n in range(4)])
    v = lambda n: F.col("tile") * 4 + n
    faces = F.array(*[F.struct((F.col("tile") * 2 + s).alias("face_id"), v(a).alias("v0"), v(b).alias("v1"), v(c).alias("v2")) for s, (a, b, c) in enumerate(((0, 1, 3), (0, 3, 2)))])
    return corner.select("scan_id", F.inline(rows)), corner.select("scan_id", "tile", F.inline(faces))


MAP = {"measured": "SELECT DISTINCT scan_id, src AS vertex_id FROM half_edges JOIN faces USING (scan_id, face_id) WHERE NOT synthetic",
       "dev": "SELECT v.scan_id, v.vertex_id, CASE WHEN m.vertex_id IS NOT NULL AND z <= 0.08::DOUBLE THEN z END AS signed FROM vertices v LEFT JOIN measured m USING (scan_id, vertex_id)"}


def plane_map(t):
    vertices, faces = nominal_planes(t)
    tri, normals = reference_tables(vertices, faces)
    tri = tri.select("*", F.concat(F.lit("body_"), F.substring("scan_id", 6, 9)).alias("body"), F.col("tile").alias("nominal_face"))
    return deviation_map(t.vertices, t.faces, tri, normals, 0.0503, 0.08, cell=1.0)


@query("m29_deviation_map", sql(f"SELECT scan_id, vertex_id, {r('signed')} AS signed FROM dev", **MAP))
def _(t):
    return plane_map(t).vertices.select("scan_id", "vertex_id", r6(F.col("signed")).alias("signed"))


@query("m29_face_values", sql(f"""SELECT scan_id, face_id, {r('avg(signed)', 9)} AS value FROM (SELECT scan_id, face_id, unnest([v0, v1, v2]) AS vertex_id FROM faces)
    LEFT JOIN dev USING (scan_id, vertex_id) GROUP BY ALL""", **MAP))
def _(t):
    return plane_map(t).faces.select("scan_id", "face_id", r6(F.col("value"), 9).alias("value"))


@query("m29_deviation_stats", sql(f"""SELECT scan_id, count(signed) AS count, {r('avg(signed)')} AS mean, {r('sqrt(avg(signed * signed))')} AS rms, {r('quantile_cont(signed, 0.95)', 5)} AS p95,
    {r(f'count(*) FILTER (abs(signed) <= 0.0503{D}) / count(signed)')} AS within FROM dev GROUP BY scan_id""", **MAP))
def _(t):
    return plane_map(t).stats.select("scan_id", "count", *[r6(F.col(c), 5 if c == "p95" else 6).alias(c) for c in ("mean", "rms", "p95", "within")])


@query("m29_per_face", sql(f"""SELECT scan_id, tile AS face_id, count(*) AS count, {r('sqrt(avg(signed * signed))')} AS rms FROM dev JOIN (SELECT k AS vertex_id, tile FROM grid) USING (vertex_id)
    WHERE signed IS NOT NULL GROUP BY ALL""", **MAP))
def _(t):
    return plane_map(t).per_face.select("scan_id", "face_id", "count", r6(F.col("rms")).alias("rms"))


@query("m29_deviation_summary", sql(f"""SELECT scan_id, count(signed) AS count, {r('avg(signed)')} AS mean, {r('max(signed)')} AS max, {r('quantile_cont(signed, 0.5)')} AS p50 FROM sdf
    WHERE abs(signed) <= {BOUND}{D} GROUP BY scan_id""", **SDF))
def _(t):
    tri, normals = nominal_boxes(t)
    near = near_bodies(t.box_points.select("scan_id", "vertex_id", "x", "y", "z"), tri, BOUND)
    s = ds.deviation_stats(sp.signed_distances(near, tri, normals, BOUND), 0.1)
    return s.select("scan_id", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "max", "p50")])


def _to_edge(a: str, b: str) -> str:
    """Distance of p to the segment from corner a to corner b."""
    along = ssub(sv(b), sv(a))
    share = f"least(greatest({sdot(ssub(sv('p'), sv(a)), along)} / nullif({sdot(along, along)}, 0), 0), 1)"
    return snorm(ssub(sv("p"), sadd(sv(a), smul(along, share))))


_INSIDE = " AND ".join(f"({sdot(scross(ssub(sv(b), sv(a)), ssub(sv('p'), sv(a))), sv('k'))}) >= 0" for a, b in (("a", "b"), ("b", "c"), ("c", "a")))


@query("j12_closest_scan_point", sql(f"""SELECT scan_id, vertex_id, {r('min(dist)', 5)} AS dist FROM (
    SELECT v.scan_id, v.vertex_id, CASE WHEN {_INSIDE} THEN abs({sdot(ssub(sv('p'), sv('a')), sv('k'))}) / {snorm(sv('k'))}
        ELSE least({_to_edge('a', 'b')}, {_to_edge('b', 'c')}, {_to_edge('c', 'a')}) END AS dist
    FROM geo g JOIN (SELECT scan_id, vertex_id, x + 0.45{D} AS px, y + 0.4{D} AS py, 0.3{D} AS pz FROM vertices) v
    ON v.scan_id = g.scan_id AND gx BETWEEN px - 3 AND px + 3 AND gy BETWEEN py - 3 AND py + 3) GROUP BY ALL HAVING min(dist) <= 1"""))
def _(t):
    probes = t.vertices.select("scan_id", "vertex_id", (F.col("x") + 0.45).alias("x"), (F.col("y") + 0.4).alias("y"), F.lit(0.3).alias("z"))
    hits = sp.closest_points(probes, geometry(t).withColumn("tri_id", F.col("face_id")), 1.0)
    return hits.select("scan_id", "vertex_id", r6(F.col("dist"), 5).alias("dist"))


@query("j13_winding_numbers", sql("""SELECT scan_id, vertex_id AS point_id, CASE WHEN x > x0 AND x < x0 + dx AND y > y0 AND y < y0 + dy AND z > z0 AND z < z0 + dz
    THEN CASE WHEN body % 10 = 3 THEN -1 ELSE 1 END ELSE 0 END AS winding FROM box_points"""))
def _(t):
    tri = mesh.corners(t.box_vertices, t.box_faces, carry=[])
    p = t.box_points.select("scan_id", F.col("vertex_id").alias("point_id"), "x", "y", "z")
    return sp.winding_numbers(p, tri, 8.0)


RAYS = "SELECT scan_id, vertex_id AS ray_id, x + 0.31::DOUBLE AS ox, y + 0.27::DOUBLE AS oy, 2.0::DOUBLE AS oz, 0.15::DOUBLE AS dx, 0.1::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM vertices"
_e1, _e2, _d = ssub(sv("b"), sv("a")), ssub(sv("c"), sv("a")), sv("d")
_det = sdot(_e1, scross(_d, _e2))
_s = ssub(sv("o"), sv("a"))


@query("j15_ray_hits", sql(f"""SELECT scan_id, ray_id, arg_min(face_id, t) AS face_id, {r('min(t)')} AS t FROM (SELECT r_.scan_id, ray_id, face_id, {sdot(_s, scross(_d, _e2))} / {_det} AS u,
    {sdot(_d, scross(_s, _e1))} / {_det} AS v, {sdot(_e2, scross(_s, _e1))} / {_det} AS t FROM rays r_ JOIN tri g ON g.scan_id = r_.scan_id AND ax BETWEEN ox - 2 AND ox + 2 AND ay BETWEEN oy - 2 AND oy + 2)
    WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 GROUP BY ALL""", rays=RAYS))
def _(t):
    rays = t.vertices.select("scan_id", F.col("vertex_id").alias("ray_id"), (F.col("x") + 0.31).alias("ox"), (F.col("y") + 0.27).alias("oy"), F.lit(2.0).alias("oz"),
                             F.lit(0.15).alias("dx"), F.lit(0.1).alias("dy"), F.lit(-1.0).alias("dz"))
    return sp.ray_hits(rays, mesh.corners(t.vertices, t.faces, carry=[]), 1.0).select("scan_id", "ray_id", "face_id", r6(F.col("t")).alias("t"))


@query("j16_sampled_surface_distance", sql(f"""SELECT scan_id, q_id, t_id, {r('d')} AS d FROM (SELECT n.scan_id, new_face AS q_id, old_face AS t_id,
    (c.gx - o.gx) * o.nx + (c.gy - o.gy) * o.ny + (c.gz - o.gz) * o.nz AS d FROM near n JOIN new_c c ON c.face_id = new_face JOIN normals o ON o.face_id = old_face)""", **NEAREST))
def _(t):
    g, f = geometry(t), F.col("face_id")
    new = g.filter(f % 2 == 1).withColumns({"gx": F.col("gx") + 0.11, "gy": F.col("gy") - 0.07, "gz": F.col("gz") + 0.02})
    samples = points(g.filter(f % 2 == 0), "face_id", "gx", "gy", "gz").join(g.select("scan_id", F.col("face_id").alias("t_id"), "nx", "ny", "nz"), ["scan_id", "t_id"])
    return sp.sample_distance(points(new, "face_id", "gx", "gy", "gz", "q_id"), samples).select("scan_id", "q_id", "t_id", r6(F.col("d")).alias("d"))


# ---------------------------------------------------------------- polygons and entities in the plane

POLY = {"poly_edges": f"""SELECT scan_id, c AS polygon_id, cx + rad * a0 AS x0, cy + rad * a1 AS y0, cx + rad * b0 AS x1, cy + rad * b1 AS y1, rad FROM (SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS c,
    (c_custkey * 37 % 100) + 0.13{D} AS cx, (c_custkey * 53 % 140) + 0.21{D} AS cy, 0.5{D} + c_custkey % 4 * 0.3{D} AS rad FROM customer), (SELECT 0 AS a0, -9 AS a1, 8 AS b0, 0 AS b1
    UNION ALL SELECT 8, 0, 3, 1 UNION ALL SELECT 3, 1, 7, 6 UNION ALL SELECT 7, 6, 0, 9 UNION ALL SELECT 0, 9, -8, 1 UNION ALL SELECT -8, 1, 0, -9) e""",
    "inside_": """SELECT p.scan_id, polygon_id, face_id, any_value(rad) AS rad FROM poly_edges p JOIN geo g ON g.scan_id = p.scan_id AND (y0 > gy) <> (y1 > gy) AND gx < (x0 - x1) * (gy - y1) / (y0 - y1) + x1
        GROUP BY ALL HAVING count(*) % 2 = 1"""}
POLY["inside_"] = POLY["inside_"].replace("any_value(rad) AS rad", "rad").replace("GROUP BY ALL", "GROUP BY p.scan_id, polygon_id, face_id, rad")


def poly_edges(t):
    from scanweave.fixtures import scan_name
    from scanweave.queries.selection import SHAPE
    k = F.col("c_custkey")
    c = t.read("customer").select(scan_name(k).alias("scan_id"), k.alias("polygon_id"), (k * 37 % 100 + 0.13).alias("cx"), (k * 53 % 140 + 0.21).alias("cy"), (k % 4 * 0.3 + 0.5).alias("rad"))
    at = lambda p: (F.col("cx") + F.col("rad") * p[0], F.col("cy") + F.col("rad") * p[1])
    rows = F.array(*[F.struct(at(a)[0].alias("x0"), at(a)[1].alias("y0"), at(b)[0].alias("x1"), at(b)[1].alias("y1")) for a, b in zip(SHAPE, SHAPE[1:] + SHAPE[:1])])
    return c.select("scan_id", "polygon_id", F.inline(rows))


def flat_centroids(t):
    return geometry(t).select("scan_id", F.col("face_id").alias("point_id"), F.col("gx").alias("u"), F.col("gy").alias("v"))


@query("j14_points_in_polygons", sql("SELECT scan_id, polygon_id, face_id AS point_id FROM inside_", **POLY))
def _(t):
    return planar.points_in_polygons(flat_centroids(t), poly_edges(t), 4.0)


@query("j14_smallest_enclosing", sql("SELECT scan_id, face_id AS point_id, arg_min(polygon_id, rad * 1000000 + polygon_id) AS polygon_id, count(*) AS depth FROM inside_ GROUP BY ALL", **POLY))
def _(t):
    return planar.smallest_enclosing(flat_centroids(t), poly_edges(t), 4.0)


ENT = {"ents": f"""SELECT scan_id, c AS entity_id, cx AS x0, cy AS y0, cx + 3 AS x1, cy + 2 AS y1 FROM (SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS c, (c_custkey * 37 % 100) + 0.13{D} AS cx,
        (c_custkey * 53 % 140) + 0.21{D} AS cy FROM customer)""",
    "entd": f"""SELECT *, sqrt((gx - x0 - f * 3) ** 2 + (gy - y0 - f * 2) ** 2) AS d FROM (SELECT g.scan_id, face_id AS point_id, entity_id, gx, gy, x0, y0,
        least(greatest(((gx - x0) * 3 + (gy - y0) * 2) / 13, 0), 1) AS f FROM geo g JOIN ents e ON e.scan_id = g.scan_id AND gx BETWEEN x0 - 2 AND x1 + 2 AND gy BETWEEN y0 - 2 AND y1 + 2)"""}


def entities(t):
    from scanweave.fixtures import scan_name
    k = F.col("c_custkey")
    x, y = k * 37 % 100 + 0.13, k * 53 % 140 + 0.21
    return t.read("customer").select(scan_name(k).alias("scan_id"), k.alias("entity_id"), x.alias("x0"), y.alias("y0"), (x + 3).alias("x1"), (y + 2).alias("y1"))


@query("j17_assign_points", sql(f"SELECT scan_id, point_id, arg_min(entity_id, d) AS entity_id, {r('min(d)')} AS d FROM entd WHERE d <= 0.8{D} GROUP BY ALL", **ENT))
def _(t):
    return planar.assign_points(flat_centroids(t), entities(t), 0.8).withColumn("d", r6(F.col("d")))


@query("a34_entity_fits", sql(f"""SELECT scan_id, entity_id, count(*) AS points, {r('max(d)')} AS max_d, {r('sqrt(avg(d * d))')} AS rms, {r(f'avg(CASE WHEN d <= 0.4003{D} THEN 1.0{D} ELSE 0 END)')} AS share
    FROM (SELECT scan_id, point_id, arg_min(entity_id, d) AS entity_id, min(d) AS d FROM entd WHERE d <= 0.8{D} GROUP BY ALL) GROUP BY ALL""", **ENT))
def _(t):
    fits = planar.entity_fits(planar.assign_points(flat_centroids(t), entities(t), 0.8), 0.4003)
    return fits.select("scan_id", "entity_id", "points", *[r6(F.col(c)).alias(c) for c in ("max_d", "rms", "share")])


@query("j18_polyline_distance", sql(f"""SELECT scan_id, chain_id, point_id, {r('min(d)')} AS d FROM (SELECT q.scan_id, q.chain_id, q.pos AS point_id, sqrt((q.u * 1.1{D} - s.u - f * (u1 - s.u)) ** 2 + (q.v * 1.1{D} - s.v - f * (v1 - s.v)) ** 2) AS d
    FROM (SELECT q.*, s.u AS su, s.v AS sv_, u1, v1 FROM loops q JOIN seg s USING (scan_id, chain_id)) q, LATERAL (SELECT su AS u, sv_ AS v, least(greatest(((q.u * 1.1{D} - su) * (u1 - su) + (q.v * 1.1{D} - sv_) * (v1 - sv_))
    / ((u1 - su) ** 2 + (v1 - sv_) ** 2), 0), 1) AS f) s) GROUP BY ALL""",
    seg="SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u1, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v1 FROM loops WINDOW w AS (PARTITION BY scan_id, chain_id ORDER BY pos)"))
def _(t):
    probes = t.loops.select("scan_id", "chain_id", F.col("pos").alias("point_id"), (F.col("u") * 1.1).alias("u"), (F.col("v") * 1.1).alias("v"))
    d = planar.polyline_distance(probes, t.loops, ["scan_id", "chain_id"])
    return d.withColumn("d", r6(F.col("d")))


@query("j26_entity_sample_distance", sql(f"""SELECT scan_id, entity_id, {r('max(d)')} AS worst FROM (SELECT e.scan_id, entity_id, n, min(sqrt((x0 + 3 * n / 8 - gx) ** 2 + (y0 + 2 * n / 8 - gy) ** 2)) AS d
    FROM ents e, range(0, 9) t(n), geo g WHERE g.scan_id = e.scan_id AND gx BETWEEN x0 + 3 * n / 8 - 1.6 AND x0 + 3 * n / 8 + 1.6 AND gy BETWEEN y0 + 2 * n / 8 - 1.6 AND y0 + 2 * n / 8 + 1.6 GROUP BY ALL)
    WHERE d <= 1.5{D} GROUP BY ALL""", **ENT))
def _(t):
    n = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n")
    s = entities(t).select("scan_id", "entity_id", "x0", "y0", n).select(
        "scan_id", "entity_id", (F.col("entity_id") * 16 + F.col("n")).alias("q_id"), (F.col("x0") + 3 * F.col("n") / 8).alias("u"), (F.col("y0") + 2 * F.col("n") / 8).alias("v"))
    near = planar.nearest_within(s, flat_centroids(t), 1.5)
    return s.join(near, ["scan_id", "q_id"]).groupBy("scan_id", "entity_id").agg(r6(F.max("dist")).alias("worst"))
