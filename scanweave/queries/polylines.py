"""Polylines: arc length, noise, moments, smoothing, areas, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6
from scanweave.operators import polylines as pl
from scanweave.registry import query

D = "::DOUBLE"
C = "scan_id, chain_id"
_SEG = lambda src, closed: f"""SELECT *, coalesce(sum(step) OVER (PARTITION BY {C} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
    sum(step) OVER (PARTITION BY {C} ORDER BY pos) AS s1 FROM (SELECT *, sqrt((u1 - u) * (u1 - u) + (v1 - v) * (v1 - v)) AS step FROM (SELECT *,
    coalesce(lead(u) OVER w{", first_value(u) OVER w" if closed else ""}) AS u1, coalesce(lead(v) OVER w{", first_value(v) OVER w" if closed else ""}) AS v1
    FROM {src} WINDOW w AS (PARTITION BY {C} ORDER BY pos))) WHERE u1 IS NOT NULL"""
_RES = lambda closed: f"""SELECT {C}, k AS pos, {r('u + (u1 - u) * f', 5)} AS u, {r('v + (v1 - v) * f', 5)} AS v FROM (SELECT seg.*, k, least(greatest((k * dt - s0) / step, 0), 1) AS f
    FROM tot JOIN (SELECT {C}, k FROM tot, range(0, 5000) t(k) WHERE k < n) USING ({C}) ASOF JOIN seg ON seg.scan_id = tot.scan_id AND seg.chain_id = tot.chain_id AND k * dt >= s0)"""
_TOT = lambda closed: f"""SELECT {C}, max(s1) AS total, greatest(round_even(max(s1) / 0.7{D}, 0), 8) AS n, max(s1) / (greatest(round_even(max(s1) / 0.7{D}, 0), 8) - {0 if closed else 1}) AS dt FROM seg GROUP BY ALL"""


@query("w03_arc_lengths", sql(f"SELECT {C}, pos, {r('s0', 5)} AS s0, {r('s1', 5)} AS s1 FROM seg", seg=_SEG("loops", True)))
def _(t):
    return pl.arc_lengths(t.loops, True).select(*pl.CHAIN, "pos", r6(F.col("s0"), 5).alias("s0"), r6(F.col("s1"), 5).alias("s1"))


@query("w03_resample_open", sql(_RES(False), seg=_SEG("polylines", False), tot=_TOT(False)))
def _(t):
    return pl.resample(t.polylines, 0.7, False).select(*pl.CHAIN, "pos", r6(F.col("u"), 5).alias("u"), r6(F.col("v"), 5).alias("v"))


@query("w03_resample_closed", sql(_RES(True), seg=_SEG("loops", True), tot=_TOT(True)))
def _(t):
    return pl.resample(t.loops, 0.7, True).select(*pl.CHAIN, "pos", r6(F.col("u"), 5).alias("u"), r6(F.col("v"), 5).alias("v"))


_WRAP = lambda src, before, after: f"""SELECT * FROM {src} UNION ALL SELECT {C}, pos + n, u, v FROM {src} JOIN (SELECT {C}, count(*) AS n FROM {src} GROUP BY ALL) USING ({C})
    WHERE pos < {after} UNION ALL SELECT {C}, pos - n, u, v FROM {src} JOIN (SELECT {C}, count(*) AS n FROM {src} GROUP BY ALL) USING ({C}) WHERE pos >= n - {before}"""
_SCAT = """SELECT *, sqrt(greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 0) / 9) AS scatter FROM (SELECT *, suu - su * su / 9 AS a, suv - su * sv / 9 AS b, svv - sv * sv / 9 AS c
    FROM (SELECT scan_id, chain_id, pos, count(*) OVER w AS n9, sum(u) OVER w AS su, sum(v) OVER w AS sv, sum(u * u) OVER w AS suu, sum(u * v) OVER w AS suv, sum(v * v) OVER w AS svv
    FROM src WINDOW w AS (PARTITION BY scan_id, chain_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) WHERE n9 = 9)"""


@query("w04_local_scatter", sql(f"SELECT {C}, pos, {r('scatter')} AS scatter FROM scat", src="SELECT * FROM polylines", scat=_SCAT))
def _(t):
    return pl.local_scatter(t.polylines, False).select(*pl.CHAIN, "pos", r6(F.col("scatter")).alias("scatter"))


@query("w04_noise_closed", sql(f"""SELECT {C}, n AS points, {r('median(scatter)')} AS noise FROM scat JOIN (SELECT {C}, count(*) AS n FROM loops GROUP BY ALL) USING ({C}) WHERE pos < n GROUP BY ALL""",
    src=_WRAP("loops", 0, 8), scat=_SCAT))
def _(t):
    return pl.noise(t.loops, True).withColumn("noise", r6(F.col("noise")))


@query("a35_local_noise", sql(f"""SELECT scan_id, {r('min(noise)')} AS noise FROM (SELECT *, sum(n) OVER (PARTITION BY scan_id ORDER BY noise) AS upto, sum(n) OVER (PARTITION BY scan_id) AS total
    FROM (SELECT scan_id, chain_id, median(scatter) AS noise, count(*) + 8 AS n FROM scat GROUP BY ALL)) WHERE upto >= total / 2 GROUP BY scan_id""", src="SELECT * FROM polylines", scat=_SCAT))
def _(t):
    per_chain = pl.noise(t.polylines, False).filter("points >= 9")
    return pl.weighted_median(per_chain, ["scan_id"], "noise", "points", "noise").withColumn("noise", r6(F.col("noise")))


_PRE = f"""SELECT {C}, pos, sum(1) OVER w AS n, sum(u) OVER w AS su, sum(v) OVER w AS sv, sum(u * u) OVER w AS suu, sum(u * v) OVER w AS suv, sum(v * v) OVER w AS svv,
    sum(u * z) OVER w AS suz, sum(v * z) OVER w AS svz, sum(z) OVER w AS sz, sum(z * z) OVER w AS szz FROM (SELECT *, u * u + v * v AS z FROM loops)
    WINDOW w AS (PARTITION BY {C} ORDER BY pos)"""


@query("w05_prefix_moments", sql(f"SELECT {C}, pos, n::DOUBLE AS m_n, {', '.join(f'{r(s, 7)} AS {m}' for s, m in zip(('su', 'sv', 'suu', 'suv', 'svv', 'suz', 'svz', 'sz', 'szz'), pl.MOMENTS[1:]))} FROM pre", pre=_PRE))
def _(t):
    p = pl.prefix_moments(t.loops)
    return p.select(*pl.CHAIN, "pos", "m_n", *[r6(F.col(m), 7).alias(m) for m in pl.MOMENTS[1:]])


_RNG = {"ranges": f"SELECT {C}, pos AS i, pos + 14 AS j FROM loops WHERE pos % 10 = 0 AND pos + 14 < 100",
    "pts": f"SELECT r_.{C.replace(', ', ', r_.')}, r_.i, r_.j, u, v, u * u + v * v AS z FROM ranges r_ JOIN loops l ON l.scan_id = r_.scan_id AND l.chain_id = r_.chain_id AND l.pos BETWEEN r_.i AND r_.j",
    "mom": f"""SELECT {C}, i, j, count(*) AS n, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS a, covar_pop(u, v) AS b, var_pop(v) AS c,
        covar_pop(u, z) / 2 AS p, covar_pop(v, z) / 2 AS q, avg(z) AS mz FROM pts GROUP BY ALL"""}


def ranges(t):
    complete = t.loops.filter("pos % 10 = 0").select(*pl.CHAIN, F.col("pos").alias("i"), (F.col("pos") + 14).alias("j"))
    return complete.filter("j < 100")


@query("w05_range_line_sse", sql(f"""SELECT {C}, i, j, {r('n * greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 0)', 5)} AS sse FROM mom WHERE n = 15""", **_RNG))
def _(t):
    m = pl.range_moments(pl.prefix_moments(t.loops), ranges(t))
    return m.select(*pl.CHAIN, "i", "j", r6(pl.line_sse(), 5).alias("sse"))


@query("a22_kasa_circle", sql(f"""SELECT {C}, i, j, {r('cu', 4)} AS cu, {r('cv', 4)} AS cv, {r('sqrt(cu * cu + cv * cv + mz - 2 * cu * mu - 2 * cv * mv)', 4)} AS radius
    FROM (SELECT *, (p * c - q * b) / (a * c - b * b) AS cu, (a * q - b * p) / (a * c - b * b) AS cv FROM mom WHERE n = 15)""", **_RNG))
def _(t):
    m = pl.range_moments(pl.prefix_moments(t.loops), ranges(t))
    cu, cv, radius = pl.kasa_circle()
    return m.select(*pl.CHAIN, "i", "j", r6(cu, 4).alias("cu"), r6(cv, 4).alias("cv"), r6(radius, 4).alias("radius"))


@query("w06_turning_angles", sql(f"""SELECT {C}, pos, {r('abs(atan2((u - pu) * (nv - v) - (v - pv) * (nu - u), (u - pu) * (nu - u) + (v - pv) * (nv - v)))')} AS angle FROM (SELECT *,
    lag(u, 3) OVER w AS pu, lag(v, 3) OVER w AS pv, lead(u, 3) OVER w AS nu, lead(v, 3) OVER w AS nv FROM src WINDOW w AS (PARTITION BY {C} ORDER BY pos))
    WHERE pu IS NOT NULL AND nu IS NOT NULL""", src=_WRAP("loops", 3, 3)))
def _(t):
    return pl.turning_angles(t.loops, 3).select(*pl.CHAIN, "pos", r6(F.col("angle")).alias("angle"))


_G = "exp(-0.5 * o * o)"


@query("w11_smooth_loop", sql(f"""SELECT a.scan_id, a.chain_id, a.pos, {r(f'sum(b.u * {_G}) / sum({_G})')} AS u, {r(f'sum(b.v * {_G}) / sum({_G})')} AS v FROM loops a, range(-4, 5) t(o)
    JOIN src b ON b.scan_id = a.scan_id AND b.chain_id = a.chain_id AND b.pos = a.pos + o GROUP BY ALL""", src=_WRAP("loops", 4, 4)))
def _(t):
    return pl.smooth(t.loops).select(*pl.CHAIN, "pos", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("a39_loop_measures", sql(f"SELECT {C}, {r('sum(u * v1 - v * u1) / 2', 5)} AS area, {r('sum(step)', 5)} AS perimeter FROM seg GROUP BY ALL", seg=_SEG("loops", True)))
def _(t):
    return pl.loop_measures(t.loops).select(*pl.CHAIN, r6(F.col("area"), 5).alias("area"), r6(F.col("perimeter"), 5).alias("perimeter"))


@query("t02_largest_loop", sql(f"SELECT scan_id, arg_max(chain_id, abs(area)) AS chain_id FROM (SELECT {C}, sum(u * v1 - v * u1) / 2 AS area FROM seg GROUP BY ALL) GROUP BY scan_id", seg=_SEG("loops", True)))
def _(t):
    return pl.loop_measures(t.loops).groupBy("scan_id").agg(F.max_by("chain_id", F.abs("area")).alias("chain_id"))


@query("w14_peak_distance", sql(f"""SELECT {C}, {r('max(m)')} AS peak FROM (SELECT {C}, pos, median(abs(sqrt(u * u + v * v) - 6)) OVER (PARTITION BY {C} ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m,
    (SELECT count(*) FROM loops l WHERE l.chain_id = src.chain_id) AS n FROM src) WHERE pos >= 0 AND pos < n GROUP BY ALL""", src=_WRAP("loops", 3, 3)))
def _(t):
    rows = t.loops.withColumn("d", F.abs(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) - 6))
    return pl.peak_distance(rows, 3).withColumn("peak", r6(F.col("peak")))


@query("w01_first_minimum", sql(f"SELECT {C}, arg_min(pos, v * 1000000 + pos) AS pos, {r('min(v)')} AS v FROM polylines GROUP BY ALL"))
def _(t):
    return t.polylines.groupBy(*pl.CHAIN).agg(F.min_by("pos", F.struct("v", "pos")).alias("pos"), r6(F.min("v")).alias("v"))


@query("w08_equal_radii", sql(f"""SELECT scan_id, a, b, {r('gap')} AS gap FROM (SELECT scan_id, k AS a, lead(k) OVER w AS b, lead(radius) OVER w - radius AS gap FROM arcs
    WINDOW w AS (PARTITION BY scan_id ORDER BY radius, k)) WHERE gap < 0.0501{D}""",
    arcs=f"SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS k, abs(c_acctbal) / 10 AS radius FROM customer"))
def _(t):
    k = F.col("c_custkey")
    arcs = t.read("customer").select(F.concat(F.lit("scan_"), (k % 5).cast("string")).alias("scan_id"), k.alias("k"), (F.abs("c_acctbal") / 10).alias("radius"))
    return pl.sorted_neighbours(arcs, ["scan_id"], "radius", "k", 0.0501).withColumn("gap", r6(F.col("gap")))


@query("g19_value_clusters", sql(f"""SELECT scan_id, k, first_value(k) OVER (PARTITION BY scan_id, grp ORDER BY k) AS part FROM (SELECT *, sum(brk) OVER (PARTITION BY scan_id ORDER BY radius, k) AS grp FROM
    (SELECT *, CASE WHEN radius - lag(radius) OVER (PARTITION BY scan_id ORDER BY radius, k) < 0.5001{D} THEN 0 ELSE 1 END AS brk FROM arcs))""",
    arcs=f"SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS k, abs(c_acctbal) / 10 AS radius FROM customer"))
def _(t):
    from scanweave.operators.graph import components
    k = F.col("c_custkey")
    arcs = t.read("customer").select(F.concat(F.lit("scan_"), (k % 5).cast("string")).alias("scan_id"), k.alias("k"), (F.abs("c_acctbal") / 10).alias("radius"))
    links = pl.sorted_neighbours(arcs, ["scan_id"], "radius", "k", 0.5001)
    return components(arcs.select("scan_id", "k"), links, node="k")


@query("w10_even_pitch", sql(f"""SELECT s, {r('phase')} AS phase, count(DISTINCT ((k % 6) + 6) % 6) AS slots, {r('max(abs(a - phase - k * 1.0471975511965976))')} AS miss FROM (SELECT *,
    round_even((a - phase) / 1.0471975511965976{D}, 0) AS k FROM ang JOIN (SELECT s, atan2(sum(sin(6 * a)), sum(cos(6 * a))) / 6 AS phase FROM ang GROUP BY s) USING (s)) GROUP BY ALL""",
    ang=f"SELECT l_suppkey AS s, (l_linenumber % 5) * 1.0471975511965976{D} + l_suppkey % 4 * 0.1{D} + (l_quantity - 25) / 400 AS a FROM lineitem"))
def _(t):
    s = F.col("l_suppkey")
    rows = t.read("lineitem").select(s.alias("s"), (F.col("l_linenumber") % 5 * 1.0471975511965976 + s % 4 * 0.1 + (F.col("l_quantity") - 25) / 400).alias("a"))
    return pl.even_pitch(rows, ["s"], "a", 6).withColumns({"phase": r6(F.col("phase")), "miss": r6(F.col("miss"))})


_SECT = """SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey // 5 AS k, c_acctbal AS area, c_nationkey % 4 <> 0 AS continues FROM customer"""


@query("w12_longest_stretch", sql("""SELECT scan_id, first, last FROM (SELECT scan_id, run, min(k) AS first, max(k) AS last, max(area) AS peak FROM (SELECT *,
    sum(brk) OVER (PARTITION BY scan_id ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(continues) OVER (PARTITION BY scan_id ORDER BY k) THEN 0 ELSE 1 END AS brk FROM sect)) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY peak DESC) = 1""", sect=_SECT))
def _(t):
    k = F.col("c_custkey")
    s = t.read("customer").select(F.concat(F.lit("scan_"), (k % 5).cast("string")).alias("scan_id"), (k / 5).cast("long").alias("k"),
                                  F.col("c_acctbal").alias("area"), (F.col("c_nationkey") % 4 != 0).alias("continues"))
    return pl.longest_stretch(s)
