"""Directions, planes, moments, noise, feature groups and edge radii."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.fixtures import scan_name
from scanweave.functions import snapping as sn
from scanweave.functions.vec import V, r6, vec
from scanweave.operators import directions as dr, mesh, noise
from scanweave.operators.quantiles import exact_percentiles
from scanweave.registry import query

D = "::DOUBLE"
FIB = f"""SELECT k::INT AS bin, cos(az) * sin(po) AS dx, sin(az) * sin(po) AS dy, cos(po) AS dz FROM (SELECT k, acos(1 - 2 * (k + 0.5{D}) / 2000) AS po,
    3.141592653589793{D} * (1 + sqrt(5{D})) * (k + 0.5{D}) AS az FROM range(0, 2000) t(k))"""


def geometry(t):
    return mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[]))


def cloud_normals(t):
    u = t.cloud.select("scan_id", "point_id", *vec().named("u"))
    n = vec("u").unit()
    return u.select("scan_id", "point_id", *n.named("n"))


BINS = {"dirs": FIB, "unit_": "SELECT scan_id, point_id, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM cloud",
        "binned": "SELECT scan_id, point_id, arg_max(bin, nx * dx + ny * dy + nz * dz) AS bin FROM unit_, dirs GROUP BY ALL"}


@query("p26_direction_bins", sql("SELECT scan_id, point_id, bin FROM binned", **BINS))
def _(t):
    return dr.direction_bins(cloud_normals(t), vec("n")).select("scan_id", "point_id", "bin")


@query("a27_cone_areas", sql(f"""SELECT scan_id, c.bin AS centre, count(*)::DOUBLE AS cone_area FROM binned b JOIN dirs d USING (bin), dirs c
    WHERE sqrt((d.dx - c.dx) ** 2 + (d.dy - c.dy) ** 2 + (d.dz - c.dz) ** 2) <= 2 * sin(radians(15) / 2) GROUP BY ALL""", **BINS))
def _(t):
    bins = dr.direction_bins(cloud_normals(t), vec("n")).withColumn("area", F.lit(1.0))
    return dr.cone_areas(bins)


@query("a27_dominant_direction")
def _(t):
    return dr.dominant_direction(geometry(t))


HIST = f"""SELECT scan_id, low, floor((gz - low) / 0.01{D}) AS bin, sum(area) AS weight FROM normals JOIN (SELECT scan_id, min(gz) AS low FROM normals GROUP BY scan_id) USING (scan_id) GROUP BY ALL"""


@query("a28_level_histogram", sql(f"SELECT scan_id, bin::BIGINT AS bin, {r('weight', 5)} AS weight FROM hist", hist=HIST))
def _(t):
    h = dr.level_histogram(geometry(t), F.col("gz"), F.col("area"), 0.01)
    return h.select("scan_id", "bin", r6(F.col("weight"), 5).alias("weight"))


@query("a28_level_peak", sql(f"""SELECT scan_id, bin::BIGINT AS bin, {r('low + (bin + 0.5) * 0.01')} AS level FROM (SELECT h.scan_id, h.low, o.k AS bin, sum(weight) AS w FROM hist h, LATERAL (SELECT h.bin + d AS k FROM (VALUES (-1), (0), (1)) v(d)) o
    GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY w DESC, bin) = 1""", hist=HIST))
def _(t):
    h = dr.level_histogram(geometry(t), F.col("gz"), F.col("area"), 0.01, smoothed=True)
    return dr.level_peak(h, 0.01).select("scan_id", "bin", r6(F.col("level")).alias("level"))


_MOM = lambda p, q: "(" + " + ".join(f"{v}{p} * {v}{q}" for v in ("a", "b", "c", "s")) + ")"


@query("a26_area_moments", sql(f"""SELECT scan_id, {r('area', 4)} AS area, {r('fx / area', 5)} AS cx, {r('fy / area', 5)} AS cy, {r('fz / area')} AS cz, {r('mxx / area - (fx / area) ** 2', 4)} AS mxx,
    {r('mxy / area - fx / area * fy / area', 4)} AS mxy, {r('mzz / area - (fz / area) ** 2')} AS mzz FROM (SELECT scan_id, sum(w) AS area, sum(w * sx / 3) AS fx, sum(w * sy / 3) AS fy, sum(w * sz / 3) AS fz,
    sum(w * {_MOM('x', 'x')} / 12) AS mxx, sum(w * {_MOM('x', 'y')} / 12) AS mxy, sum(w * {_MOM('z', 'z')} / 12) AS mzz
    FROM (SELECT *, area AS w, by_ AS by, ax + bx + cx AS sx, ay + by_ + cy AS sy, az + bz + cz AS sz FROM normals) GROUP BY scan_id)""".replace("by * by", "by_ * by_").replace("bx * by", "bx * by_").replace(", by_ AS by,", ",")))
def _(t):
    m = dr.area_moments(mesh.corners(t.vertices, t.faces, carry=[]))
    return m.select("scan_id", r6(F.col("area"), 4).alias("area"), r6(F.col("cx"), 5).alias("cx"), r6(F.col("cy"), 5).alias("cy"), r6(F.col("cz")).alias("cz"),
                    r6(F.col("mxx"), 4).alias("mxx"), r6(F.col("mxy"), 4).alias("mxy"), r6(F.col("mzz")).alias("mzz"))


@query("a26_principal_frame")
def _(t):
    tri = mesh.corners(t.vertices, t.faces, carry=[])
    return dr.principal_frame(tri, dr.area_moments(tri))


@query("a25_robust_planes")
def _(t):
    return dr.robust_planes(t.patch_points.filter("kind = 'plane'"), ["scan_id", "label"])


@query("m09_detect_planes")
def _(t):
    tri = mesh.corners(t.box_vertices, t.outward_faces, carry=[])
    return dr.detect_planes(mesh.face_geometry(tri), 0.3)


@query("a30_direction_clusters")
def _(t):
    from scanweave.queries.scalars import items
    rows = items(t).select("scan_id", F.col("item_id").cast("long").alias("item_id"), "nx", "ny", "nz", (F.col("item_id") % 13 + 1).cast("double").alias("weight"))
    return dr.cluster_directions(rows, 5.0)


FEATURES = {"feats": f"""SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS feature_id, c_custkey % 3 AS plane_id, CASE WHEN c_custkey % 2 = 0 THEN 'boss' ELSE 'pocket' END AS kind,
    'flat' AS top, CASE WHEN c_custkey % 7 = 0 THEN 'profile' ELSE 'circle' END AS shape, (c_custkey % 4) * 0.5{D} + 2 AS radius, (c_custkey % 6) * 0.25{D} + 1 AS height FROM customer"""}


def features(t):
    k = F.col("c_custkey")
    return t.read("customer").select(
        scan_name(k).alias("scan_id"), k.alias("feature_id"), (k % 3).alias("plane_id"), F.when(k % 2 == 0, "boss").otherwise("pocket").alias("kind"), F.lit("flat").alias("top"),
        F.when(k % 7 == 0, "profile").otherwise("circle").alias("shape"), (k % 4 * 0.5 + 2).alias("radius"), (k % 6 * 0.25 + 1).alias("height"))


@query("a31_feature_groups", sql("""SELECT scan_id, feature_id, dense_rank() OVER (PARTITION BY scan_id ORDER BY f) - 1 AS group_id FROM (SELECT *, min(feature_id) OVER (PARTITION BY scan_id, plane_id, kind, top, shape,
    CASE WHEN shape = 'profile' THEN feature_id END, round(radius, 3), round(height, 3)) AS f FROM feats)""", **FEATURES))
def _(t):
    return dr.feature_groups(features(t), ["radius"]).select("scan_id", "feature_id", "group_id")


_SNAP = "[5.0, 1.0, 0.5, 0.25, 0.1, 0.05]::DOUBLE[]"


@query("a32_shared_radius", sql(f"""SELECT s, {r(f'coalesce(round_even(m / f, 0) * f, m)')} AS radius FROM (SELECT *, list_filter({_SNAP}, lambda g: abs(m - round_even(m / g, 0) * g) <= greatest(3 * u, 0.005{D}))[1] AS f FROM (
    SELECT s, m, greatest(1.4826{D} * median(abs(radius - m)) / sqrt(count(*)), median(unc)) AS u FROM rad JOIN (SELECT s, median(radius) AS m FROM rad GROUP BY s) USING (s) GROUP BY s, m))""",
    rad=f"SELECT l_suppkey AS s, 3 + l_suppkey % 5 * 0.4{D} + (l_quantity - 25) / 700 AS radius, l_discount / 20 + 0.001{D} AS unc FROM lineitem"))
def _(t):
    s = F.col("l_suppkey")
    rows = t.read("lineitem").select(s.alias("s"), (s % 5 * 0.4 + 3 + (F.col("l_quantity") - 25) / 700).alias("radius"), (F.col("l_discount") / 20 + 0.001).alias("unc"))
    m = exact_percentiles(rows, ["s"], "radius", {"m": 0.5})
    unc = exact_percentiles(rows, ["s"], "unc", {"w": 0.5})
    mad = exact_percentiles(rows.join(m, "s").withColumn("g", F.abs(F.col("radius") - F.col("m"))), ["s"], "g", {"mad": 0.5})
    n = rows.groupBy("s").agg(F.count("*").alias("n"))
    row = m.join(unc, "s").join(mad, "s").join(n, "s")
    u = F.greatest(1.4826 * F.col("mad") / F.sqrt("n"), F.col("w"))
    snap = sn.snap_length(F.col("m"), u)
    return row.withColumn("_s", snap).select("s", r6(F.coalesce("_s.value", "m")).alias("radius"))


@query("a33_edge_radius", sql(f"""SELECT s, {r('m')} AS radius, {r(f'greatest(1.2533{D} * 1.4826{D} * mad / sqrt(n), 0.02{D} * m, 0.03{D})')} AS uncertainty, {r('rms')} AS rms, n AS samples, {r('p10')} AS p10, {r('p90')} AS p90 FROM
    (SELECT s, m, median(abs(radius - m)) AS mad, count(*) AS n, sqrt(sum(e * e * k) / sum(k)) AS rms, quantile_cont(radius, 0.1) AS p10, quantile_cont(radius, 0.9) AS p90 FROM rad JOIN (SELECT s, median(radius) AS m FROM rad GROUP BY s)
    USING (s) GROUP BY s, m)""", rad="SELECT l_suppkey AS s, 1 + (l_quantity - 25) / 90 AS radius, l_tax / 2 AS e, l_linenumber AS k FROM lineitem"))
def _(t):
    rows = t.read("lineitem").select(F.col("l_suppkey").alias("s"), (1 + (F.col("l_quantity") - 25) / 90).alias("radius"), (F.col("l_tax") / 2).alias("rms"), F.col("l_linenumber").alias("points"))
    e = dr.edge_radii(rows, ["s"], F.lit(12), 0.03)
    return e.select("s", "samples", *[r6(F.col(c)).alias(c) for c in ("radius", "uncertainty", "rms", "p10", "p90")])


@query("a38_normal_cone", sql(f"SELECT scan_id, {r('degrees(acos(least(greatest(quantile_cont(nz, 0.01), -1), 1)))', 5)} AS spread FROM normals GROUP BY scan_id"))
def _(t):
    p = exact_percentiles(geometry(t), ["scan_id"], "nz", {"c": 0.01})
    return p.select("scan_id", r6(F.degrees(F.acos(F.least(F.greatest("c", F.lit(-1.0)), F.lit(1.0)))), 5).alias("spread"))


@query("a43_design_noise", sql(f"SELECT scan_id, {r('greatest(0.01, least(arg_max(rms, area), 0.05))')} AS noise FROM (SELECT 'scan_' || (p_partkey % 5) AS scan_id, p_retailprice AS area, p_size / 1000{D} AS rms FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_retailprice DESC, p_partkey) = 1) GROUP BY scan_id".replace("/ 1000::DOUBLE", "/ 1000")))
def _(t):
    k = F.col("p_partkey")
    best = t.read("part").groupBy(scan_name(k).alias("scan_id")).agg(F.max_by(F.col("p_size") / 1000, F.struct("p_retailprice", -k)).alias("rms"))
    return best.select("scan_id", r6(F.greatest(F.lit(0.01), F.least("rms", F.lit(0.05)))).alias("noise"))


@query("p32_canonical_cylinders", sql(f"""SELECT scan_id, label, ox, oy, {r('oz + 0.5 * (min(z - oz) + max(z - oz))')} AS oz, 1.0{D} AS nz FROM patch_points JOIN (SELECT label, ox, oy, oz FROM primitives WHERE kind = 'cylinder') USING (label)
    GROUP BY scan_id, label, ox, oy, oz"""))
def _(t):
    from scanweave.functions.primitives import positive_axis
    prims = t.primitives.filter("kind = 'cylinder'").withColumn("nz", -F.col("nz"))
    a = positive_axis(vec("n"))
    rows = t.patch_points.select("scan_id", "label", "x", "y", "z").join(prims, ["scan_id", "label"])
    rows = rows.select("scan_id", "label", *vec().named(), *vec("o").named("o"), *a.named("a"))
    h = (vec() - vec("o")).dot(vec("a"))
    ends = rows.groupBy("scan_id", "label", "ox", "oy", "oz", "ax", "ay", "az").agg(F.min(h).alias("lo"), F.max(h).alias("hi"))
    o = vec("o") + vec("a") * (0.5 * (F.col("lo") + F.col("hi")))
    return ends.select("scan_id", "label", o.x.alias("ox"), o.y.alias("oy"), r6(o.z).alias("oz"), F.col("az").alias("nz"))


@query("w07_value_runs")
def _(t):
    k = F.col("c_custkey")
    rows = t.read("customer").select(scan_name(k).alias("scan_id"), (k % 50).alias("plane_id"), k.alias("item_id"), (F.col("c_acctbal") / 100).alias("height"))
    return dr.value_runs(rows, ["scan_id", "plane_id"], "height", 2.0)


@query("j21_duplicate_features", sql(f"""SELECT DISTINCT a.scan_id, a.feature_id FROM fx a JOIN fx b ON a.scan_id = b.scan_id AND a.feature_id <> b.feature_id AND a.plane_id <> b.plane_id
    AND abs(a.x - b.x) < 6 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.8{D} AND abs(a.size_ - b.size_) <= 0.2{D} * greatest(a.size_, b.size_) AND abs(a.z - b.z) < 3
    AND (a.area < b.area OR (a.area = b.area AND a.feature_id > b.feature_id))""",
    fx=f"SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS feature_id, c_custkey % 3 AS plane_id, (c_custkey * 37 % 50)::DOUBLE AS x, (c_custkey * 53 % 70)::DOUBLE AS y, 0.5{D} AS z, 2.0{D} + c_custkey % 4 AS size_, c_acctbal AS area FROM customer"))
def _(t):
    k = F.col("c_custkey")
    f = t.read("customer").select(
        scan_name(k).alias("scan_id"), k.alias("feature_id"), (k % 3).alias("plane_id"), (k * 37 % 50).cast("double").alias("x"), (k * 53 % 70).cast("double").alias("y"), F.lit(0.5).alias("z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (F.lit(2.0) + k % 4).alias("size"), F.col("c_acctbal").alias("area"))
    return dr.same_features(f, 1.0, 0.8, 0.2)


@query("a10_jet_fit")
def _(t):
    n = mesh.vertex_normals(t.vertices, mesh.corners(t.vertices, t.faces))
    return noise.jet_fit(n, 1.0, 12)


@query("a11_scan_noise")
def _(t):
    n = mesh.vertex_normals(t.vertices, mesh.corners(t.vertices, t.faces))
    return noise.estimate_noise(n, 1.0, 12)


@query("a12_noise_per_unit")
def _(t):
    n = mesh.vertex_normals(t.vertices, mesh.corners(t.vertices, t.faces))
    return noise.noise_per_unit(n, 12)
