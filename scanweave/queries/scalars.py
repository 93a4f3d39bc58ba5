"""Scalar functions: vectors, frames, primitives, outlines, snapping, bands, measuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, scross, sdot, smul, snorm, sql, ssub, sunit, sv
from scanweave.fixtures import scan_name
from scanweave.functions import frames, outlines as ol, primitives as pr, snapping as sn
from scanweave.functions.vec import V, frame_from_axis, r6, transform, vec
from scanweave.operators import mesh
from scanweave.operators.measure import measure_pairs
from scanweave.registry import query
from scanweave.session import dealt

D = "::DOUBLE"


def named(prefix, vector):
    return [r6(c).alias(f"{prefix}{n}") for n, c in zip("xyz", vector)]


def snamed(prefix, vector):
    return ", ".join(f"{r(c)} AS {prefix}{n}" for n, c in zip("xyz", vector))


# ---------------------------------------------------------------- vectors and frames

@query("p01_unit_vectors", sql(f"SELECT scan_id, point_id, {snamed('u', sunit(smul(sv(), 'point_id % 4')))} FROM cloud"))
def _(t):
    return t.cloud.select("scan_id", "point_id", *named("u", (vec() * (F.col("point_id") % 4)).unit()))


FRAME = {"e": f"SELECT scan_id, point_id, {', '.join(f'{c} AS a{n}' for n, c in zip('xyz', sunit(('x * 8', 'y', 'z'))))} FROM cloud",
         "h": """SELECT *, CASE WHEN abs(ax) < 0.9::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS hx,
            CASE WHEN abs(ax) < 0.9::DOUBLE THEN 0.0 ELSE 1.0 END::DOUBLE AS hy, 0.0::DOUBLE AS hz FROM e""",
         "g": f"SELECT *, {', '.join(f'{c} AS e{n}' for n, c in zip('xyz', sunit(scross(sv('a'), sv('h')))))} FROM h"}


@query("p02_frame_from_axis", sql(f"SELECT scan_id, point_id, {snamed('u', sv('e'))}, {snamed('w', scross(sv('a'), sv('e')))} FROM g", **FRAME))
def _(t):
    u, w = frame_from_axis(V(F.col("x") * 8, F.col("y"), F.col("z")))
    return t.cloud.select("scan_id", "point_id", *named("u", u), *named("w", w))


@query("p03_rigid_transform", sql(f"""SELECT scan_id, vertex_id, {r('c * x - s * y + k')} AS x, {r('s * x + c * y - 2 * k')} AS y, {r('z + 0.5')} AS z FROM vertices
    JOIN (SELECT 'scan_' || r_regionkey AS scan_id, r_regionkey AS k, cos(r_regionkey * 0.3{D}) AS c, sin(r_regionkey * 0.3{D}) AS s FROM region) USING (scan_id)"""))
def _(t):
    k = F.col("r_regionkey")
    c, s, one, zero = F.cos(k * 0.3), F.sin(k * 0.3), F.lit(1.0), F.lit(0.0)
    m = [c, -s, zero, k.cast("double"), s, c, zero, -2.0 * k, zero, zero, one, F.lit(0.5), zero, zero, zero, one]
    moves = t.read("region").select(scan_name(k).alias("scan_id"), F.array(*m).alias("m"))
    return t.vertices.join(moves, "scan_id").select("scan_id", "vertex_id", *[r6(c).alias(n) for n, c in zip("xyz", transform(F.col("m"), vec()))])


@query("p04_unit_scale_recentre", sql(f"""SELECT scan_id, vertex_id, {', '.join(f"{r(f'{n} * s - (max({n}) OVER w + min({n}) OVER w) * s / 2', 9)} AS {n}" for n in 'xyz')}
    FROM vertices JOIN (SELECT 'scan_' || r_regionkey AS scan_id, ([1.0, 10.0, 1000.0, 25.4, 1.0])[r_regionkey + 1]{D} AS s FROM region) USING (scan_id)
    WINDOW w AS (PARTITION BY scan_id)"""))
def _(t):
    k = F.col("r_regionkey")
    units = t.read("region").select(scan_name(k).alias("scan_id"), F.array(*[F.lit(u) for u in ("mm", "cm", "m", "in", "mm")])[k].alias("unit"))
    box = mesh.bounds(t.vertices).join(units, "scan_id")
    scale = sn.unit_scale(F.col("unit"))
    joined = t.vertices.join(box, "scan_id")
    return joined.select("scan_id", "vertex_id", *[
        r6(F.col(n) * scale - (F.col(f"max_{n}") + F.col(f"min_{n}")) * scale / 2, 9).alias(n) for n in "xyz"])


# ---------------------------------------------------------------- primitives

PRIM = "patch_points JOIN (SELECT label, ox, oy, oz, radius, minor_radius, half_angle FROM primitives) USING (label)"
H, RHO = "(z - oz)", "sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy))"
DIST = f"""CASE kind WHEN 'plane' THEN {H} WHEN 'sphere' THEN sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)) - radius
    WHEN 'cylinder' THEN {RHO} - radius WHEN 'cone' THEN {RHO} * cos(half_angle) - {H} * sin(half_angle)
    ELSE sqrt(({RHO} - radius) * ({RHO} - radius) + {H} * {H}) - minor_radius END"""
FIT = {"dist": f"SELECT scan_id, label, kind, point_id, x, y, z, nx, ny, nz, ox, oy, oz, radius, minor_radius, half_angle, {DIST} AS d FROM {PRIM}"}


def on_primitives(t):
    p = t.patch_points.withColumnsRenamed({"nx": "mx", "ny": "my", "nz": "mz"}).drop("kind")
    return p.join(t.primitives, ["scan_id", "label"])


@query("p06_signed_distance", sql(f"SELECT scan_id, label, point_id, {r('d')} AS d, count(*) AS n FROM dist GROUP BY scan_id, label, point_id, d", **FIT))
def _(t):
    d = on_primitives(t).select("scan_id", "label", "point_id", r6(pr.signed_distance(vec())).alias("d"))
    return d.groupBy("scan_id", "label", "point_id", "d").agg(F.count("*").alias("n"))


@query("p07_surface_normals", sql(f"""SELECT scan_id, label, point_id, {r('a / greatest(rho, 1e-300) * (x - ox)')} AS ux, {r('a / greatest(rho, 1e-300) * (y - oy)')} AS uy,
    {r('b')} AS uz, count(*) AS n FROM (SELECT *, {RHO} AS rho,
    CASE kind WHEN 'plane' THEN 0 WHEN 'cylinder' THEN 1 WHEN 'sphere' THEN {RHO} / (d + radius) WHEN 'cone' THEN cos(half_angle)
        ELSE ({RHO} - radius) / (d + minor_radius) END AS a,
    CASE kind WHEN 'plane' THEN 1 WHEN 'cylinder' THEN 0 WHEN 'sphere' THEN {H} / (d + radius) WHEN 'cone' THEN -sin(half_angle)
        ELSE {H} / (d + minor_radius) END AS b FROM dist) GROUP BY ALL""", **FIT))
def _(t):
    d = pr.with_surface_normal(on_primitives(t), vec(), "s").select("scan_id", "label", "point_id", *named("u", vec("s")))
    return d.groupBy(*d.columns).agg(F.count("*").alias("n"))


@query("f07_consensus", sql(f"""SELECT scan_id, label, count(*) FILTER (abs(d) < 0.0121{D} AND agree > 0.999{D}) AS inliers FROM (SELECT *,
    abs(CASE kind WHEN 'plane' THEN nz WHEN 'cylinder' THEN (nx * (x - ox) + ny * (y - oy)) / {RHO}
    WHEN 'sphere' THEN (nx * (x - ox) + ny * (y - oy) + nz * {H}) / (d + radius)
    WHEN 'cone' THEN cos(half_angle) * (nx * (x - ox) + ny * (y - oy)) / {RHO} - sin(half_angle) * nz
    ELSE (({RHO} - radius) * (nx * (x - ox) + ny * (y - oy)) / {RHO} + {H} * nz) / (d + minor_radius) END) AS agree FROM dist) GROUP BY ALL""", **FIT))
def _(t):
    rows = pr.consensus(on_primitives(t), vec(), vec("m"), 0.0121, 0.999)
    return rows.groupBy("scan_id", "label").agg(F.count_if("inlier").alias("inliers"))


@query("a19_fit_statistics", sql(f"""SELECT scan_id, label, count(*) AS point_count, {r('sqrt(avg(d * d))')} AS rms, {r('max(abs(d))')} AS max_abs,
    {r('max(sigma)')} AS sigma, {r(f'avg(CASE WHEN abs(d) <= 3 * greatest(sigma, 1e-4) THEN 1.0{D} ELSE 0 END)')} AS inlier_ratio
    FROM dist JOIN (SELECT scan_id, label, 1.4826{D} * median(abs(d - m)) AS sigma FROM dist JOIN (SELECT scan_id, label, median(d) AS m FROM dist GROUP BY ALL)
    USING (scan_id, label) GROUP BY ALL) USING (scan_id, label) GROUP BY ALL""", **FIT))
def _(t):
    from scanweave.operators.fitting import fit_statistics
    s = fit_statistics(on_primitives(t).withColumn("d", pr.signed_distance(vec())), "d", ["scan_id", "label"])
    return s.select("scan_id", "label", "point_count", *[r6(F.col(c)).alias(c) for c in ("rms", "max_abs", "sigma", "inlier_ratio")])


@query("a44_region_rms", sql(f"SELECT scan_id, label, {r('sqrt(avg(d * d))')} AS rms FROM dist GROUP BY ALL", **FIT))
def _(t):
    d = pr.signed_distance(vec())
    return on_primitives(t).groupBy("scan_id", "label").agg(r6(F.sqrt(F.avg(d * d))).alias("rms"))


@query("p17_face_verdict", sql(f"""SELECT scan_id, label, CASE WHEN abs(d) <= 0.0061{D} THEN 'pass' WHEN abs(d) <= 3 * 0.0061{D} THEN 'fail' ELSE 'far' END AS state,
    count(*) AS n FROM dist GROUP BY ALL""", **FIT))
def _(t):
    state = pr.face_state(pr.signed_distance(vec()), 0.0061)
    return on_primitives(t).groupBy("scan_id", "label", state.alias("state")).agg(F.count("*").alias("n"))


@query("p25_degenerate_fits", sql(f"""SELECT scan_id, label, CASE WHEN kind IN ('sphere', 'cylinder') THEN radius * 3 > 20 * e WHEN kind = 'torus'
    THEN radius * 3 > 20 * e OR minor_radius > 20 * e WHEN kind = 'cone' THEN half_angle * 3 > radians(89) ELSE false END AS degenerate FROM
    (SELECT scan_id, label, kind, radius, minor_radius, half_angle, greatest(label % 10 * 0.12{D}, 1e-9) AS e FROM primitives)"""))
def _(t):
    rows = t.primitives.withColumns({"radius": F.col("radius") * 3, "half_angle": F.col("half_angle") * 3})
    return rows.select("scan_id", "label", pr.is_degenerate(F.col("label") % 10 * 0.12).alias("degenerate"))


# Tilted items: one per supplier, measured against its successors in the scan.
ITEMS = {
    "raw_items": f"""SELECT scan_id, label, CASE kind WHEN 'plane' THEN 'plane' WHEN 'sphere' THEN 'point' ELSE 'axis' END AS item,
        CASE WHEN kind IN ('cylinder', 'sphere') THEN 2 * radius END AS diameter, ox, oy, oz + label % 7 AS oz,
        {', '.join(f'{c} AS n{n}' for n, c in zip('xyz', sunit((f'(label % 3 - 1){D}', f'(label % 4 // 2){D}', f'2.0{D}'))))} FROM primitives""",
    "item_pairs": """SELECT x.scan_id, x.label AS a, y.label AS b FROM primitives x JOIN primitives y
        ON y.label IN (x.label + 1, x.label + 3, x.label + 12, x.label + 25) AND x.scan_id = y.scan_id""",
    "met": "SELECT p.scan_id, p.a, p.b, i.item AS ia, j.item AS ib, i.diameter AS da_, j.diameter AS db_, "
        + ", ".join(f"i.{c}{n} AS {c}{n}_a, j.{c}{n} AS {c}{n}_b" for c in "on" for n in "xyz")
        + " FROM item_pairs p JOIN raw_items i ON i.label = p.a JOIN raw_items j ON j.label = p.b",
}
_gap, _na, _nb = ssub(sv("o", "_b"), sv("o", "_a")), sv("n", "_a"), sv("n", "_b")
_ang = f"degrees(acos(least(abs({sdot(_na, _nb)}), 1.0)))"
_mean = sunit(tuple(f"({a} + sign({sdot(_na, _nb)}) * {b})" for a, b in zip(_na, _nb)))
ITEMS["angled"] = f"""SELECT *, CASE WHEN ia = 'point' OR ib = 'point' THEN NULL WHEN ia = ib THEN {_ang} ELSE 90 - {_ang} END AS angle FROM met"""


def items(t):
    n = V((F.col("label") % 3 - 1).cast("double"), (F.col("label") % 4 / 2).cast("int").cast("double"), F.lit(2.0)).unit()
    return t.primitives.select(
        "scan_id", F.col("label").alias("item_id"), pr.item_kind().alias("item"), pr.item_diameter().alias("diameter"),
        "ox", "oy", (F.col("oz") + F.col("label") % 7).alias("oz"), *[c.alias(f"n{a}") for a, c in zip("xyz", n)])


def item_pairs(t):
    a = t.primitives.select("scan_id", F.col("label").alias("a"))
    steps = F.array(*[F.col("a") + k for k in (1, 3, 12, 25)])
    return a.withColumn("b", F.explode(steps)).join(a.withColumnRenamed("a", "b"), ["scan_id", "b"], "left_semi")


@query("p28_measure_items", sql(f"SELECT scan_id, label AS item_id, item, {r('diameter')} AS diameter, {snamed('o', sv('o'))}, {snamed('n', sv('n'))} FROM raw_items", **ITEMS))
def _(t):
    return items(t).select("scan_id", "item_id", "item", r6(F.col("diameter")).alias("diameter"), *named("o", vec("o")), *named("n", vec("n")))


@query("j20_measure_pairs", sql(f"""SELECT scan_id, a, b, {r('angle')} AS angle_deg, coalesce(angle < 0.5{D}, false) AS parallel, da_ AS diameter_a, db_ AS diameter_b,
    CASE WHEN ia = 'point' OR ib = 'point' THEN 'point' WHEN angle < 0.5{D} THEN 'parallel' WHEN ia = 'axis' AND ib = 'axis' THEN 'shortest' END AS distance_kind,
    {r(f'''CASE WHEN ia = 'point' THEN CASE ib WHEN 'plane' THEN abs({sdot(_gap, _nb)}) WHEN 'axis' THEN {snorm(scross(_gap, _nb))} ELSE {snorm(_gap)} END
    WHEN ib = 'point' THEN CASE ia WHEN 'plane' THEN abs({sdot(_gap, _na)}) ELSE {snorm(scross(_gap, _na))} END
    WHEN ia = 'plane' AND ib = 'plane' THEN CASE WHEN angle < 0.5{D} THEN abs({sdot(_gap, _mean)}) END
    WHEN ia = ib AND angle < 0.5{D} THEN {snorm(scross(_gap, _na))}
    WHEN ia = ib THEN abs({sdot(_gap, scross(_na, _nb))}) / {snorm(scross(_na, _nb))}
    WHEN angle < 0.5{D} THEN abs(CASE WHEN ia = 'plane' THEN {sdot(_gap, _na)} ELSE {sdot(_gap, _nb)} END) END''')} AS distance FROM angled""", **ITEMS))
def _(t):
    m = measure_pairs(items(t), item_pairs(t))
    return m.withColumns({"angle_deg": r6(F.col("angle_deg")), "distance": r6(F.col("distance"))})


@query("p24_line_angles", sql(f"""SELECT scan_id, a, b, {r(_ang, 4)} AS angle, CASE WHEN abs(nx_a) < 1e-7 AND abs(ny_a) < 1e-7 THEN 'Z' END AS axis FROM met""", **ITEMS))
def _(t):
    side = lambda s: items(t).select("scan_id", F.col("item_id").alias(s), *[F.col(f"n{n}").alias(f"n{n}_{s}") for n in "xyz"])
    m = item_pairs(t).join(side("a"), ["scan_id", "a"]).join(side("b"), ["scan_id", "b"])
    return m.select("scan_id", "a", "b", r6(pr.line_angle_deg(vec("n", "_a"), vec("n", "_b")), 4).alias("angle"),
                    pr.parallel_axis(vec("n", "_a"), 1e-4).alias("axis"))


_m = tuple(f"((oa + ob_) * 0.5{D})" for _ in range(3))
_onb = ssub(sv("o", "_a"), smul(_nb, sdot(ssub(sv("o", "_a"), sv("o", "_b")), _nb)))
_mid = tuple(f"(({a}) + ({b})) * 0.5{D}" for a, b in zip(sv("o", "_a"), _onb))
_d = sunit(scross(_na, _nb))
_det = sdot(_na, scross(_nb, _d))
_rhs = (sdot(_na, sv("o", "_a")), sdot(_nb, sv("o", "_b")), sdot(_d, (f"1.0{D}", f"2.0{D}", f"3.0{D}")))
_pt = tuple(f"(({_rhs[0]}) * ({p}) + ({_rhs[1]}) * ({q}) + ({_rhs[2]}) * ({s})) / ({_det})"
            for p, q, s in zip(scross(_nb, _d), scross(_d, _na), scross(_na, _nb)))


@query("p20_constructed_geometry", sql(f"""SELECT scan_id, a, b, {snamed('off', tuple(f'{o} + 0.75{D} * {n}' for o, n in zip(sv('o', '_a'), _na)))},
    CASE WHEN {_ang} > 1 THEN 'not_parallel' ELSE 'ok' END AS mid_status, {', '.join(f"CASE WHEN {_ang} <= 1 THEN {r(c)} END AS mid{n}" for n, c in zip('xyz', _mid))},
    CASE WHEN {_ang} < 1 THEN 'parallel_planes' ELSE 'ok' END AS axis_status, {', '.join(f"CASE WHEN {_ang} >= 1 THEN {r(c, 5)} END AS ax{n}" for n, c in zip('xyz', _pt))},
    {', '.join(f"CASE WHEN {_ang} >= 1 THEN {r(c)} END AS dir{n}" for n, c in zip('xyz', _d))} FROM met""", **ITEMS))
def _(t):
    side = lambda s: items(t).select("scan_id", F.col("item_id").alias(s), *[F.col(f"{c}{n}").alias(f"{c}{n}_{s}") for c in "on" for n in "xyz"])
    m = item_pairs(t).join(side("a"), ["scan_id", "a"]).join(side("b"), ["scan_id", "b"])
    oa, ob, na, nb = vec("o", "_a"), vec("o", "_b"), vec("n", "_a"), vec("n", "_b")
    off, _ = frames.offset_plane(oa, na, F.lit(0.75))
    m = frames.mid_plane(m, oa, na, ob, nb, "mid")
    m = frames.axis_of_planes(m, oa, na, ob, nb, V(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "ax")
    return m.select(
        "scan_id", "a", "b", *named("off", off), "mid_status", F.col("ax_status").alias("axis_status"),
        *[F.when(F.col("mid_status") == "ok", r6(F.col(f"mid{n}"))).alias(f"mid{n}") for n in "xyz"],
        *[F.when(F.col("ax_status") == "ok", r6(F.col(f"ax{n}"), 5)).alias(f"ax{n}") for n in "xyz"],
        *[F.when(F.col("ax_status") == "ok", r6(F.col(f"axd{n}"))).alias(f"dir{n}") for n in "xyz"])


# u0 of an axis, then turned by an angle about it.
THROUGH = {
    "ax_": "SELECT scan_id, label, nx AS ax, ny AS ay, nz AS az, ox, oy, oz, (label % 24 * 15)::DOUBLE AS deg FROM raw_items",
    "u_": f"SELECT *, {', '.join(f'{c} AS u{n}' for n, c in zip('xyz', sunit(tuple(f'({b} - ax * a{n})' for n, b in zip('xyz', ('1.0', '0.0', '0.0'))))))} FROM ax_",
    "w_": f"SELECT *, {', '.join(f'{c} AS w{n}' for n, c in zip('xyz', scross(sv('a'), sv('u'))))} FROM u_",
    "t_": "SELECT *, " + ", ".join(f"cos(radians(deg)) * u{n} + sin(radians(deg)) * w{n} AS t{n}" for n in "xyz") + " FROM w_",
}


@query("p20_plane_through_axis", sql(f"SELECT scan_id, label, {snamed('n', scross(sv('a'), sv('t')))} FROM t_", **ITEMS, **THROUGH))
def _(t):
    p = frames.plane_through_axis(items(t), vec("n"), (F.col("item_id") % 24 * 15).cast("double"), "p")
    return p.select("scan_id", F.col("item_id").alias("label"), *named("n", vec("p")))


@query("p31_section_frames", sql(f"""SELECT scan_id, label, {snamed('o', tuple(f'o{n} + 0.25{D} * a{n}' for n in 'xyz'))}, {snamed('x', sv('u'))},
    {snamed('n', tuple(f'CASE WHEN label % 2 = 0 THEN -a{n} ELSE a{n} END' for n in 'xyz'))} FROM u_
    UNION ALL SELECT 'standard', k, 0, 0, 0, x0, x1, x2, n0, n1, n2 FROM (VALUES (0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0),
    (2, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)) s(k, x0, x1, x2, n0, n1, n2)""", **ITEMS, **THROUGH))
def _(t):
    i = frames.plane_frame(items(t), vec("o"), vec("n"), F.lit(0.25), F.col("item_id") % 2 == 0, "f")
    out = i.select("scan_id", F.col("item_id").cast("long").alias("label"), *named("o", vec("fo")), *named("x", vec("fx")), *named("n", vec("fn")))
    rows = []
    for k, (a, b) in enumerate(frames.STANDARD_FRAMES.values()):
        normal = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        rows.append(("standard", k, 0.0, 0.0, 0.0, *map(float, a), *map(float, normal)))
    return out.unionByName(t.spark.createDataFrame(rows, out.schema))


ROT = {
    "z_": f"SELECT *, {', '.join(f'{c} AS r{n}' for n, c in zip('xyz', sunit(tuple(f'({b} - az * a{n})' for n, b in zip('xyz', ('0.0', '0.0', '1.0'))))))} FROM ax_ WHERE abs(az) < 0.999999",
    "q_": f"SELECT *, {', '.join(f'cos(radians(deg)) * r{n} + sin(radians(deg)) * ({c}) AS q{n}' for n, c in zip('xyz', scross(sv('a'), sv('r'))))} FROM z_",
}


@query("p31_rotational_frames", sql(f"""SELECT scan_id, label, {snamed('o', ssub(sv('o'), smul(sv('a'), sdot(sv('o'), sv('a')))))}, {snamed('n', scross(sv('a'), sv('q')))} FROM q_""",
    **ITEMS, **THROUGH, **ROT))
def _(t):
    i = items(t).filter("abs(nz) < 0.999999")
    i = frames.rotational_frame(i, vec("o"), vec("n"), (F.col("item_id") % 24 * 15).cast("double"), "f")
    return i.select("scan_id", F.col("item_id").alias("label"), *named("o", vec("fo")), *named("n", vec("fn")))


@query("p10_plane_coordinates", sql(f"""SELECT scan_id, vertex_id, {r(f'(x - 3) * 0.6{D} + (y - 4) * 0.8{D}')} AS u, {r(f'(x - 3) * -0.64{D} + (y - 4) * 0.48{D} + (z - 1) * 0.6{D}')} AS v,
    {r(f'3 + ((x - 3) * 0.6{D} + (y - 4) * 0.8{D}) * 0.6{D} + ((x - 3) * -0.64{D} + (y - 4) * 0.48{D} + (z - 1) * 0.6{D}) * -0.64{D}')} AS back_x FROM vertices"""))
def _(t):
    o, x, y = (V(*[F.lit(float(c)) for c in v]) for v in ((3, 4, 1), (0.6, 0.8, 0.0), (-0.64, 0.48, 0.6)))
    u, v = frames.to_plane(vec(), o, x, y)
    return t.vertices.select("scan_id", "vertex_id", r6(u).alias("u"), r6(v).alias("v"), r6(frames.from_plane(u, v, o, x, y).x).alias("back_x"))


@query("p11_fold_about_axis", sql(f"""SELECT scan_id, vertex_id, {r('h')} AS along, {r('sqrt(greatest(s - h * h, 0))')} AS radial FROM (SELECT scan_id, vertex_id,
    (x - 1) * 0.6{D} + (z - 2) * 0.8{D} AS h, (x - 1) * (x - 1) + y * y + (z - 2) * (z - 2) AS s FROM vertices)"""))
def _(t):
    h, rho = frames.fold(vec(), V(F.lit(1.0), F.lit(0.0), F.lit(2.0)), V(F.lit(0.6), F.lit(0.0), F.lit(0.8)))
    return t.vertices.select("scan_id", "vertex_id", r6(h).alias("along"), r6(rho).alias("radial"))


@query("p19_curvatures", sql(f"""SELECT scan_id, point_id, {r('t / 2 + sqrt(greatest(t * t / 4 - k, 0))', 5)} AS k1, {r('t / 2 - sqrt(greatest(t * t / 4 - k, 0))', 5)} AS k2 FROM (SELECT *,
    -(s11 * a - 2 * s12 * b + s22 * c) / (g * det) AS t, (a * c - b * b) / (g * g * det) AS k FROM (SELECT *, 1 + e * e AS s11, d * e AS s12, 1 + d * d AS s22,
    (1 + d * d) * (1 + e * e) - d * e * d * e AS det, sqrt(1 + d * d + e * e) AS g FROM (SELECT scan_id, point_id, x AS a, y AS b, z AS c, x + y AS d, y - z AS e FROM cloud)))"""))
def _(t):
    x, y, z = vec()
    k1, k2 = pr.curvatures(x, y, z, x + y, y - z)
    return t.cloud.select("scan_id", "point_id", r6(k1, 5).alias("k1"), r6(k2, 5).alias("k2"))


@query("p22_quadric_top", sql(f"""SELECT scan_id, vertex_id, {r(f'1 + 0.1{D} * x - 0.2{D} * y + 0.01{D} * x * x + 0.02{D} * x * y - 0.03{D} * y * y')} AS height,
    {r(f'0.1{D} + 0.02{D} * x + 0.02{D} * y')} AS gu, {r(f'-0.2{D} + 0.02{D} * x - 0.06{D} * y')} AS gv, {r(f'atan(sqrt(0.05{D} + z * z * 0))')} AS tilt FROM vertices"""))
def _(t):
    c = [F.lit(v) for v in (1.0, 0.1, -0.2, 0.01, 0.02, -0.03)]
    gu, gv = frames.top_gradient(c, F.col("x"), F.col("y"))
    return t.vertices.select("scan_id", "vertex_id", r6(frames.top_height(c, F.col("x"), F.col("y"))).alias("height"),
                             r6(gu).alias("gu"), r6(gv).alias("gv"), r6(frames.top_tilt(c)).alias("tilt"))


@query("p23_frame_adjustment", sql(f"""SELECT scan_id, point_id, {r('CASE q WHEN 0 THEN x2 WHEN 1 THEN -y2 WHEN 2 THEN -x2 ELSE y2 END')} AS x,
    {r('CASE q WHEN 0 THEN y2 WHEN 1 THEN x2 WHEN 2 THEN -y2 ELSE -x2 END')} AS y, {r('z1')} AS z FROM (SELECT *, CASE WHEN fx THEN -x ELSE x END AS x2,
    CASE WHEN fx THEN -y1 ELSE y1 END AS y2 FROM (SELECT *, point_id % 4 AS q, point_id % 3 = 0 AS fx, CASE WHEN point_id % 2 = 0 THEN -y ELSE y END AS y1,
    CASE WHEN point_id % 2 = 0 THEN -z ELSE z END AS z1 FROM cloud))"""))
def _(t):
    k = F.col("point_id")
    p = frames.adjusted(vec(), k % 2 == 0, k % 3 == 0, k)
    return t.cloud.select("scan_id", "point_id", *[r6(c).alias(n) for n, c in zip("xyz", p)])


# ---------------------------------------------------------------- triangles

PROBE = {"probe": f"""SELECT *, gx + (face_id % 7 - 3) * 0.4{D} AS px, gy + (face_id % 5 - 2) * 0.5{D} AS py, gz + 0.3{D} AS pz FROM geo""",
    "de": "SELECT *, " + ", ".join(f"{sdot(a, b)} AS d{n}" for n, (a, b) in enumerate([
        (ssub(sv('b'), sv('a')), ssub(sv('p'), sv('a'))), (ssub(sv('c'), sv('a')), ssub(sv('p'), sv('a'))),
        (ssub(sv('b'), sv('a')), ssub(sv('p'), sv('b'))), (ssub(sv('c'), sv('a')), ssub(sv('p'), sv('b'))),
        (ssub(sv('b'), sv('a')), ssub(sv('p'), sv('c'))), (ssub(sv('c'), sv('a')), ssub(sv('p'), sv('c')))], start=1)) + " FROM probe",
    "vv": "SELECT *, d3 * d6 - d5 * d4 AS va, d5 * d2 - d1 * d6 AS vb, d1 * d4 - d3 * d2 AS vc FROM de",
    "feat": """SELECT *, CASE WHEN d1 <= 0 AND d2 <= 0 THEN 1 WHEN d3 >= 0 AND d4 <= d3 THEN 2 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN 4
        WHEN d6 >= 0 AND d5 <= d6 THEN 3 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN 6 WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN 5 ELSE 0 END AS code FROM vv""",
    "bary": """SELECT *, CASE code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN d1 / (d1 - d3) WHEN 3 THEN 0 WHEN 6 THEN 0
        WHEN 5 THEN 1 - (d4 - d3) / ((d4 - d3) + (d5 - d6)) ELSE vb / (va + vb + vc) END AS v, CASE code WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 4 THEN 0
        WHEN 3 THEN 1 WHEN 6 THEN d2 / (d2 - d6) WHEN 5 THEN (d4 - d3) / ((d4 - d3) + (d5 - d6)) ELSE vc / (va + vb + vc) END AS w FROM feat"""}


def probed(t):
    g = mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[]))
    f = F.col("face_id")
    return g.select("*", (F.col("gx") + (f % 7 - 3) * 0.4).alias("px"), (F.col("gy") + (f % 5 - 2) * 0.5).alias("py"), (F.col("gz") + 0.3).alias("pz"))


@query("p08_closest_on_triangle", sql(f"""SELECT scan_id, face_id, code, {', '.join(
    f"{r(f'{a} + v * ({b} - {a}) + w * ({c} - {a})')} AS q{n}" for n, a, b, c in zip('xyz', sv('a'), sv('b'), sv('c')))} FROM bary""", **PROBE))
def _(t):
    found = pr.with_closest_on_triangle(probed(t), vec("p"))
    return found.select("scan_id", "face_id", "code", *named("q", vec("q")))


_A, _B, _C = (ssub(sv(c), sv("p")) for c in "abc")


@query("p09_solid_angle", sql(f"""SELECT scan_id, face_id, {r(f'2 * atan2({sdot(_A, scross(_B, _C))}, {snorm(_A)} * {snorm(_B)} * {snorm(_C)} + {sdot(_A, _B)} * {snorm(_C)}'
    f' + {sdot(_B, _C)} * {snorm(_A)} + {sdot(_C, _A)} * {snorm(_B)})')} AS angle FROM probe""", **PROBE))
def _(t):
    p = vec("p")
    return probed(t).select("scan_id", "face_id", r6(pr.solid_angle(vec("a") - p, vec("b") - p, vec("c") - p)).alias("angle"))


# ---------------------------------------------------------------- outlines

SHAPES = {"shape_points": f"""SELECT l_orderkey, l_linenumber, l_suppkey AS s, (l_partkey % 200 - 100) / 10{D} AS x, (l_quantity - 25) / 3 AS y,
    (l_suppkey % 9 - 4){D} AS cx, (l_suppkey % 5 - 2){D} AS cy, l_suppkey % 7 * 0.4{D} AS ang, 4.0{D} + l_suppkey % 3 AS size_ FROM lineitem""",
    "tu": "SELECT *, (x - cx) * cos(ang) + (y - cy) * sin(ang) AS u, (y - cy) * cos(ang) - (x - cx) * sin(ang) AS v, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS rho FROM shape_points",
    "qq": f"""SELECT *, abs(u) - (size_ - 1) AS q1, abs(v) - (size_ / 2 - 1) AS q2, greatest(2 + 0.5{D} - rho, rho - (size_ - 0.5{D})) AS b1,
        greatest(0.8{D} - ((y - cy) * cos(ang) - (x - cx) * sin(ang)), 0.8{D} - ((x - cx) * sin(ang + 1.2{D}) - (y - cy) * cos(ang + 1.2{D}))) AS b2 FROM tu"""}
_RND = lambda a, b, rad: f"sqrt(greatest({a}, 0) * greatest({a}, 0) + greatest({b}, 0) * greatest({b}, 0)) + least(greatest({a}, {b}), 0) - {rad}"


def shape_points(t):
    s = F.col("l_suppkey")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", s.alias("s"), ((F.col("l_partkey") % 200 - 100) / 10).alias("x"), ((F.col("l_quantity") - 25) / 3).alias("y"),
        (s % 9 - 4).cast("double").alias("cx"), (s % 5 - 2).cast("double").alias("cy"), (s % 7 * 0.4).alias("ang"), (F.lit(4.0) + s % 3).alias("size_"))


@query("p12_outline_distances", sql(f"""SELECT s, count(*) AS n, {r(f'sum(CASE s % 5 WHEN 0 THEN rho - size_ WHEN 1 THEN greatest(rho - size_, u - 1.5{D}) WHEN 2 THEN '
    f'sqrt((u - least(greatest(u, -(size_ - 1.5{D})), size_ - 1.5{D})) * (u - least(greatest(u, -(size_ - 1.5{D})), size_ - 1.5{D})) + v * v) - 1.5{D} WHEN 3 THEN '
    f'{_RND("q1", "q2", 1)} ELSE {_RND("b1", "b2", f"0.5{D}")} END)')} AS total,
    {r(f'min(CASE s % 5 WHEN 0 THEN rho - size_ WHEN 1 THEN greatest(rho - size_, u - 1.5{D}) WHEN 2 THEN '
    f'sqrt((u - least(greatest(u, -(size_ - 1.5{D})), size_ - 1.5{D})) * (u - least(greatest(u, -(size_ - 1.5{D})), size_ - 1.5{D})) + v * v) - 1.5{D} WHEN 3 THEN '
    f'{_RND("q1", "q2", 1)} ELSE {_RND("b1", "b2", f"0.5{D}")} END)')} AS low FROM qq GROUP BY s""", **SHAPES))
def _(t):
    x, y, cx, cy, a, size = (F.col(c) for c in ("x", "y", "cx", "cy", "ang", "size_"))
    kind = F.col("s") % 5
    d = (F.when(kind == 0, ol.circle(x, y, cx, cy, size)).when(kind == 1, ol.cut_circle(x, y, cx, cy, size, a, F.lit(1.5)))
         .when(kind == 2, ol.slot(x, y, cx, cy, a, 2 * size, F.lit(3.0)))
         .when(kind == 3, ol.rounded_rect(x, y, cx, cy, a, 2 * size, size, F.lit(1.0)))
         .otherwise(ol.ring_arm(x, y, cx, cy, F.lit(2.0), size, a, F.lit(1.2), F.lit(0.6), F.lit(0.5))))
    return shape_points(t).withColumn("d", d).groupBy("s").agg(F.count("*").alias("n"), r6(F.sum("d")).alias("total"), r6(F.min("d")).alias("low"))


_TAU = f"6.283185307179586{D}"


@query("p13_segment_arc_distances", sql(f"""SELECT s, {r('sum(seg)')} AS segment_total, {r('sum(CASE WHEN along <= 2 THEN abs(rho - size_) ELSE least('
    'sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))) END)', 5)} AS arc_total FROM (SELECT *,
    sqrt((x - cx - tt * 3) * (x - cx - tt * 3) + (y - cy - tt * 4) * (y - cy - tt * 4)) AS seg,
    w - {_TAU} * floor(w / {_TAU}) AS along FROM (SELECT *, least(greatest(((x - cx) * 3 + (y - cy) * 4) / 25, 0), 1) AS tt, atan2(y - cy, x - cx) - atan2(sy - cy, sx - cx) AS w
    FROM (SELECT *, cx + size_ * cos(ang) AS sx, cy + size_ * sin(ang) AS sy, cx + size_ * cos(ang + 2) AS ex, cy + size_ * sin(ang + 2) AS ey FROM tu))) GROUP BY s""", **SHAPES))
def _(t):
    x, y, cx, cy, a, size = (F.col(c) for c in ("x", "y", "cx", "cy", "ang", "size_"))
    seg = ol.segment_distance(x, y, cx, cy, cx + 3, cy + 4)
    arc = ol.arc_distance(x, y, cx, cy, size, cx + size * F.cos(a), cy + size * F.sin(a), cx + size * F.cos(a + 2), cy + size * F.sin(a + 2), F.lit(True))
    return shape_points(t).select("s", seg.alias("seg"), arc.alias("arc")).groupBy("s").agg(
        r6(F.sum("seg")).alias("segment_total"), r6(F.sum("arc"), 5).alias("arc_total"))


CARRIERS = {"pairs_": f"""SELECT c_custkey AS k, c_custkey % 3 AS kind, c_custkey % 63 * 0.1{D} AS na, (c_custkey % 11){D} AS oa, c_custkey % 50 * 0.125{D} + 0.05{D} AS nb,
    (c_custkey % 7){D} AS ob, (c_custkey % 9){D} AS ax, (c_custkey % 5){D} AS ay, 3.0{D} + c_custkey % 4 AS ar, 2.5{D} AS bx, (c_custkey % 8){D} AS by_c, 2.0{D} + c_custkey % 5 AS br,
    (c_custkey % 13){D} AS hx, c_custkey % 17 + 0.3{D} AS hy, c_custkey % 6 >= 3 AS tangent FROM customer""",
    "ll": f"SELECT *, cos(na) * sin(nb) - sin(na) * cos(nb) AS det, sqrt((bx - ax) * (bx - ax) + (by_c - ay) * (by_c - ay)) AS d FROM pairs_",
    "cc": "SELECT *, ax - (ax * cos(na) + ay * sin(na) - oa) * cos(na) AS fx, ay - (ax * cos(na) + ay * sin(na) - oa) * sin(na) AS fy, (ar * ar - br * br + d * d) / (2 * d) AS along FROM ll",
    "hh": "SELECT *, sqrt(greatest(ar * ar - (fx - ax) * (fx - ax) - (fy - ay) * (fy - ay), 0)) AS half, sqrt(greatest(ar * ar - along * along, 0)) AS hgt FROM cc",
    "two": """SELECT *, CASE kind WHEN 1 THEN fx - half * sin(na) ELSE ax + along * (bx - ax) / d - hgt * (by_c - ay) / d END AS x1,
        CASE kind WHEN 1 THEN fy + half * cos(na) ELSE ay + along * (by_c - ay) / d + hgt * (bx - ax) / d END AS y1,
        CASE kind WHEN 1 THEN fx + half * sin(na) ELSE ax + along * (bx - ax) / d + hgt * (by_c - ay) / d END AS x2,
        CASE kind WHEN 1 THEN fy - half * cos(na) ELSE ay + along * (by_c - ay) / d - hgt * (bx - ax) / d END AS y2 FROM hh"""}
_NEAR = "(x1 - hx) * (x1 - hx) + (y1 - hy) * (y1 - hy) <= (x2 - hx) * (x2 - hx) + (y2 - hy) * (y2 - hy)"


@query("p29_carrier_intersections", sql(f"""SELECT k, {r(f'CASE WHEN kind = 0 THEN CASE WHEN abs(det) < 1e-3 THEN hx - (hx * cos(na) + hy * sin(na) - oa) * cos(na) ELSE (oa * sin(nb) - ob * sin(na)) / det END '
    f'WHEN tangent THEN CASE kind WHEN 1 THEN fx ELSE ax + ar * (bx - ax) / d * CASE WHEN along >= 0 THEN 1 ELSE -1 END END WHEN {_NEAR} THEN x1 ELSE x2 END')} AS x,
    {r(f'CASE WHEN kind = 0 THEN CASE WHEN abs(det) < 1e-3 THEN hy - (hx * cos(na) + hy * sin(na) - oa) * sin(na) ELSE (ob * cos(na) - oa * cos(nb)) / det END '
    f'WHEN tangent THEN CASE kind WHEN 1 THEN fy ELSE ay + ar * (by_c - ay) / d * CASE WHEN along >= 0 THEN 1 ELSE -1 END END WHEN {_NEAR} THEN y1 ELSE y2 END')} AS y FROM two""", **CARRIERS))
def _(t):
    k = F.col("c_custkey")
    dbl = lambda c: c.cast("double")
    rows = t.read("customer").select(
        k.alias("k"), (k % 3).alias("kind"), (k % 63 * 0.1).alias("na"), dbl(k % 11).alias("oa"), (k % 50 * 0.125 + 0.05).alias("nb"), dbl(k % 7).alias("ob"),
        dbl(k % 9).alias("ax"), dbl(k % 5).alias("ay"), (F.lit(3.0) + k % 4).alias("ar"), F.lit(2.5).alias("bx"), dbl(k % 8).alias("by"),
        (F.lit(2.0) + k % 5).alias("br"), dbl(k % 13).alias("hx"), (k % 17 + 0.3).alias("hy"), (k % 6 >= 3).alias("tangent"))
    c = {n: F.col(n) for n in rows.columns}
    a = ol.line_line(c["na"], c["oa"], c["nb"], c["ob"], c["hx"], c["hy"])
    b = ol.line_circle(c["na"], c["oa"], c["ax"], c["ay"], c["ar"], c["hx"], c["hy"], c["tangent"])
    d = ol.circle_circle(c["ax"], c["ay"], c["ar"], c["bx"], c["by"], c["br"], c["hx"], c["hy"], c["tangent"])
    pick = lambda n: F.when(c["kind"] == 0, a[n]).when(c["kind"] == 1, b[n]).otherwise(d[n])
    return rows.select("k", r6(pick(0)).alias("x"), r6(pick(1)).alias("y"))


@query("p29_foot_points", sql(f"""SELECT k, {r('hx - (hx * cos(na) + hy * sin(na) - oa) * cos(na)')} AS lx, {r('hy - (hx * cos(na) + hy * sin(na) - oa) * sin(na)')} AS ly,
    {r('ax + ar * (hx + 0.5 - ax) / sqrt((hx + 0.5 - ax) * (hx + 0.5 - ax) + (hy - ay) * (hy - ay))')} AS cx FROM pairs_""", **CARRIERS))
def _(t):
    k = F.col("c_custkey")
    dbl = lambda c: c.cast("double")
    lx, ly = ol.foot_on_line(k % 63 * 0.1, dbl(k % 11), dbl(k % 13), k % 17 + 0.3)
    cx, _ = ol.foot_on_circle(dbl(k % 9), dbl(k % 5), F.lit(3.0) + k % 4, dbl(k % 13) + 0.5, k % 17 + 0.3)
    return t.read("customer").select(k.alias("k"), r6(lx).alias("lx"), r6(ly).alias("ly"), r6(cx).alias("cx"))


@query("p30_arc_points", sql(f"""SELECT k, n, {r('ax + ar * cos(na + sweep * n / m)')} AS u, {r('ay + ar * sin(na + sweep * n / m)')} AS v FROM
    (SELECT *, greatest(8, ceil(abs(sweep) / radians(3)))::BIGINT AS m FROM (SELECT *, CASE WHEN k % 2 = 0 THEN nb ELSE -nb END AS sweep FROM pairs_)), range(0, 200) t(n) WHERE n <= m""", **CARRIERS))
def _(t):
    k = F.col("c_custkey")
    sweep = F.when(k % 2 == 0, k % 50 * 0.125 + 0.05).otherwise(-(k % 50 * 0.125 + 0.05))
    pts = ol.curve_points((k % 9).cast("double"), (k % 5).cast("double"), F.lit(3.0) + k % 4, k % 63 * 0.1, sweep, ol.arc_steps(sweep))
    return dealt(t.read("customer").select("c_custkey"), "c_custkey").select(k.alias("k"), F.inline(pts)).select("k", "n", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("p30_circle_points", sql(f"""SELECT k, n, {r(f'ax + ar * cos({_TAU} * n / 120)')} AS u, {r(f'ay + ar * sin({_TAU} * n / 120)')} AS v FROM pairs_, range(0, 121) t(n)""", **CARRIERS))
def _(t):
    k = F.col("c_custkey")
    pts = ol.curve_points((k % 9).cast("double"), (k % 5).cast("double"), F.lit(3.0) + k % 4, F.lit(0.0), F.lit(6.283185307179586), ol.circle_steps())
    return dealt(t.read("customer").select("c_custkey"), "c_custkey").select(k.alias("k"), F.inline(pts)).select("k", "n", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("p30_template_edges", sql(f"""SELECT k, count(*) AS edges, {r('sum(len)', 5)} AS perimeter FROM (
    SELECT k, unnest(CASE k % 4 WHEN 0 THEN [h2 * 2, 3.141592653589793{D} * w / 2, h2 * 2, 3.141592653589793{D} * w / 2]
    WHEN 1 THEN [q, l - 2, q, w - 2, q, l - 2, q, w - 2] WHEN 2 THEN [l * (6.283185307179586{D} - 2 * acos(1.5{D} / l)), 2 * sqrt(l * l - 2.25{D})]
    ELSE [{_TAU} * l] END) AS len FROM (SELECT c_custkey AS k, 8.0{D} + c_custkey % 5 AS l, 4.0{D} + c_custkey % 3 AS w, (8.0{D} + c_custkey % 5) / 2 - (4.0{D} + c_custkey % 3) / 2 AS h2,
    3.141592653589793{D} / 2 AS q FROM customer)) GROUP BY k"""))
def _(t):
    k = F.col("c_custkey")
    l, w, a = F.lit(8.0) + k % 5, F.lit(4.0) + k % 3, k % 63 * 0.1
    cx, cy = (k % 9).cast("double"), (k % 5).cast("double")
    edges = (F.when(k % 4 == 0, ol.slot_edges(cx, cy, a, l, w)).when(k % 4 == 1, ol.rounded_rect_edges(cx, cy, a, l, w, F.lit(1.0)))
             .when(k % 4 == 2, ol.cut_circle_edges(cx, cy, l, a, F.lit(1.5))).otherwise(ol.circle_edges(cx, cy, l)))
    e = t.read("customer").select(k.alias("k"), F.inline(edges))
    c = {n: F.col(n) for n in ("x0", "y0", "x1", "y1", "cx", "cy", "radius")}
    _, sweep = ol.arc_angles(c["cx"], c["cy"], c["x0"], c["y0"], c["x1"], c["y1"], F.lit(True))
    length = F.when(c["radius"].isNull(), F.sqrt((c["x1"] - c["x0"]) ** 2 + (c["y1"] - c["y0"]) ** 2)).otherwise(c["radius"] * F.abs(sweep))
    return e.withColumn("len", length).groupBy("k").agg(F.count("*").alias("edges"), r6(F.sum("len"), 5).alias("perimeter"))


# ---------------------------------------------------------------- snapping, tolerances, bands

_STEPS = "[5.0, 1.0, 0.5, 0.25, 0.1, 0.05]::DOUBLE[]"
_FITS = f"list_filter({_STEPS}, lambda s: abs(x - round_even(x / s, 0) * s) <= greatest(3 * u, 0.005{D}))[1]"


@query("p14_snap_length", sql(f"""SELECT k, n, CASE WHEN abs(x - 12.3456{D}) <= greatest(3 * u, 0.005{D}) THEN 12.3456{D} ELSE {r(f'round_even(x / {_FITS}, 0) * {_FITS}')} END AS value,
    CASE WHEN abs(x - 12.3456{D}) > greatest(3 * u, 0.005{D}) THEN {_FITS} END AS step FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
    l_extendedprice % 100 + 0.0021{D} AS x, l_discount / 10 + 0.0003{D} AS u FROM lineitem) GROUP BY ALL"""))
def _(t):
    x, u = F.col("l_extendedprice") % 100 + 0.0021, F.col("l_discount") / 10 + 0.0003
    s = t.read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                                  sn.snap_length(x, u, F.array(F.lit(12.3456))).alias("s"))
    return s.select("k", "n", F.when(F.col("s.step").isNull(), F.col("s.value")).otherwise(r6(F.col("s.value"))).alias("value"), F.col("s.step").alias("step")).distinct()


_ANG = "[0.0, 15.0, 30.0, 45.0, 60.0, 90.0, 120.0, 135.0, 150.0, 180.0]::DOUBLE[]"


@query("p15_snap_angle", sql(f"""SELECT k, CASE WHEN gap <= greatest(3 * u, 0.05{D}) THEN best END AS value FROM (SELECT k, u, list_min(list_transform({_ANG}, lambda c: abs(x - c))) AS gap,
    list_filter({_ANG}, lambda c: abs(x - c) = list_min(list_transform({_ANG}, lambda e: abs(x - e))))[1] AS best FROM
    (SELECT o_orderkey AS k, o_totalprice % 180 AS x, (o_orderkey % 9)::DOUBLE * 0.31 AS u FROM orders))"""))
def _(t):
    k = F.col("o_orderkey")
    return t.read("orders").select(k.alias("k"), sn.snap_angle(F.col("o_totalprice") % 180, (k % 9).cast("double") * 0.31).alias("value"))


_TOLS = "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0]::DOUBLE[]"


@query("p16_tolerances", sql(f"""SELECT k, CASE WHEN noise IS NULL THEN 0.1{D} ELSE coalesce(list_filter({_TOLS}, lambda s: s >= 2.5{D} * noise)[1], 1.0{D}) END AS proposed,
    {r('4 * noise')} AS growth, coalesce(0.3{D} < 2.5{D} * noise, false) AS too_tight, {r('least(greatest(noise * 30 - 1, 0.001), 10)')} AS clamped FROM
    (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN (o_totalprice % 500) / 1000 + 0.00001{D} END AS noise FROM orders)"""))
def _(t):
    k = F.col("o_orderkey")
    noise = F.when(k % 9 != 0, F.col("o_totalprice") % 500 / 1000 + 0.00001)
    clamped = F.when(noise.isNotNull(), sn.clamp_tolerance(noise * 30 - 1)).otherwise(sn.clamp_tolerance(F.lit(-1.0)))
    return t.read("orders").select(
        k.alias("k"), sn.propose_tolerance(noise).alias("proposed"), r6(sn.growth_tolerance(noise)).alias("growth"),
        sn.too_tight(F.lit(0.3), noise).alias("too_tight"), r6(clamped).alias("clamped"))


_BANDS = "CASE WHEN signed IS NULL THEN 9 " + " ".join(
    f"WHEN signed < {e} THEN {n}" for n, e in enumerate(("-0.0991", "-2 * 0.0991 / 3", "-0.0991 / 3", "-0.0203", "0.0203", "0.0991 / 3", "2 * 0.0991 / 3", "0.0991"))) + " ELSE 8 END"


@query("p18_deviation_bands", sql(f"SELECT scan_id, {_BANDS} AS band, count(*) AS n FROM deviations GROUP BY ALL".replace("0.0991", f"0.0991{D}").replace("0.0203", f"0.0203{D}")))
def _(t):
    band = sn.band_index(F.col("signed"), F.lit(0.0203), F.lit(0.0991))
    return t.deviations.groupBy("scan_id", band.alias("band")).agg(F.count("*").alias("n"))


_NICE = lambda x: f"(SELECT min(c) FROM (SELECT s * pow(10, floor(log10({x}))) AS c FROM (VALUES (1), (2), (5), (10)) v(s)) WHERE c >= {x} * (1 - 1e-12))"


@query("p18_automatic_range", sql(f"""SELECT scan_id, {r(f'greatest({_NICE("p99")}, {_NICE(f"0.04{D} * 1.5")}, {_NICE(f"0.12{D} * 1.0001")})')} AS range_ FROM
    (SELECT scan_id, list_sort(list(abs(signed)) FILTER (signed IS NOT NULL))[least(count(signed) - 1, floor(count(signed) * 0.99{D}))::BIGINT + 1] AS p99 FROM deviations GROUP BY scan_id)"""))
def _(t):
    from scanweave.operators.quantiles import exact_percentiles
    p = exact_percentiles(t.deviations, ["scan_id"], F.abs("signed"), {"p99": 0.99}, rank="index")
    return p.select("scan_id", r6(sn.automatic_range(F.col("p99"), F.lit(0.04))).alias("range_"))


@query("p27_applicable_kinds", sql("""SELECT o_orderkey AS k, array_to_string(list_filter(['plane', 'sphere', 'cylinder', 'cone', 'torus'], lambda e:
    (o_orderkey % 2 = 0 OR e <> 'sphere') AND (o_orderkey % 3 > 0 OR e = 'plane') AND (o_orderkey % 5 > 0 OR e IN ('sphere', 'cylinder'))
    AND (o_orderkey % 7 > 0 OR e = 'cone') AND (o_orderkey % 11 > 0 OR e = 'torus')), ',') AS kinds FROM orders"""))
def _(t):
    k = F.col("o_orderkey")
    kinds = pr.applicable_kinds(k % 2 == 1, k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 11 == 0)
    return t.read("orders").select(k.alias("k"), F.array_join(kinds, ",").alias("kinds"))
