"""Deviation statistics over `deviations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6
from scanweave.operators import deviation_stats as ds
from scanweave.operators.quantiles import robust_sigma
from scanweave.registry import query

TOL = 0.04
_P = lambda p, x="signed": f"quantile_cont({x}, {p})"
STATS = f"""SELECT scan_id, count(signed) AS count, avg(signed) AS mean, stddev_pop(signed) AS std, sqrt(avg(signed * signed)) AS rms,
    min(signed) AS min, max(signed) AS max, {_P(0.05)} AS p05, {_P(0.5)} AS p50, {_P(0.95)} AS p95, {_P(0.99, 'abs(signed)')} AS p99_abs,
    count(*) FILTER (abs(signed) <= {TOL}::DOUBLE) / count(signed) AS within, count(*) FILTER (signed > {TOL}::DOUBLE) / count(signed) AS above,
    count(*) FILTER (signed < -{TOL}::DOUBLE) / count(signed) AS below, greatest(3 * {TOL}::DOUBLE, {_P(0.995, 'abs(signed)')}) AS histogram_limit
    FROM deviations GROUP BY scan_id"""
MEASURES = ["mean", "std", "rms", "min", "max", "p05", "p50", "p95", "p99_abs", "within", "above", "below", "histogram_limit"]


@query("a15_deviation_stats", sql(f"SELECT scan_id, count, {', '.join(f'{r(m)} AS {m}' for m in MEASURES)}, within >= 0.95::DOUBLE AS passed FROM stats", stats=STATS))
def _(t):
    s = ds.deviation_stats(t.deviations, TOL)
    return s.withColumns({m: r6(F.col(m)) for m in MEASURES})


@query("a15_histogram", sql("""SELECT scan_id, least(floor((least(greatest(signed, -l), l) + l) * 41 / (2 * l)), 40)::BIGINT AS bin, count(*) AS n
    FROM deviations JOIN (SELECT scan_id, histogram_limit AS l FROM stats) USING (scan_id) WHERE signed IS NOT NULL GROUP BY ALL""", stats=STATS))
def _(t):
    return ds.histogram(t.deviations, ds.deviation_stats(t.deviations, TOL))


@query("a15_unsigned_summary", sql(f"""SELECT scan_id, count(signed) AS measured, count(*) AS total, {r('sqrt(avg(signed * signed))')} AS rms,
    {r('max(abs(signed))')} AS max, {r(f'count(*) FILTER (abs(signed) <= {TOL}::DOUBLE) / count(signed)')} AS within,
    {r('list_sort(list(abs(signed)) FILTER (signed IS NOT NULL))[least(count(signed) - 1, floor(count(signed) * 0.95::DOUBLE))::BIGINT + 1]')} AS p95
    FROM deviations GROUP BY scan_id"""))
def _(t):
    return ds.unsigned_summary(t.deviations, TOL).withColumns({m: r6(F.col(m)) for m in ("rms", "max", "within", "p95")})


@query("a16_face_deviation", sql(f"""SELECT scan_id, body, face_id, count(*) AS count, {r('avg(signed)')} AS mean, {r('sqrt(avg(signed * signed))')} AS rms,
    {r('max(abs(signed))')} AS max_abs, {r(f'count(*) FILTER (abs(signed) <= {TOL}::DOUBLE) / count(*)')} AS within
    FROM deviations WHERE signed IS NOT NULL GROUP BY ALL"""))
def _(t):
    return ds.face_deviation(t.deviations, TOL).withColumns({m: r6(F.col(m)) for m in ("mean", "rms", "max_abs", "within")})


VALUES = "SELECT scan_id, vertex_id, CASE WHEN vertex_id % 9 <> 0 THEN z - 0.05::DOUBLE END AS signed FROM vertices"


@query("a17_face_means", sql(f"""SELECT scan_id, face_id, {r('avg(signed)', 9)} AS value FROM
    (SELECT scan_id, face_id, unnest([v0, v1, v2]) AS vertex_id FROM faces) LEFT JOIN vals USING (scan_id, vertex_id) GROUP BY ALL""", vals=VALUES))
def _(t):
    values = t.vertices.select("scan_id", "vertex_id", F.when(F.col("vertex_id") % 9 != 0, F.col("z") - 0.05).alias("signed"))
    return ds.face_means(values, t.faces).select("scan_id", "face_id", r6(F.col("value"), 9).alias("value"))


@query("f09_measured_vertices", sql("SELECT DISTINCT scan_id, src AS vertex_id FROM half_edges WHERE face_id IN (SELECT face_id FROM faces WHERE NOT synthetic)"))
def _(t):
    return ds.measured_vertices(t.faces)


@query("f10_points_near_bodies", sql("""SELECT scan_id, vertex_id FROM vertices WHERE x BETWEEN 9.5 AND 41.5 AND y BETWEEN 3.5 AND 77.5 AND z BETWEEN -0.02 AND 0.09"""))
def _(t):
    inside = F.col("x").between(9.5, 41.5) & F.col("y").between(3.5, 77.5) & F.col("z").between(-0.02, 0.09)
    return t.vertices.filter(inside).select("scan_id", "vertex_id")


@query("a18_robust_sigma", sql(f"""SELECT scan_id, {r('1.4826::DOUBLE * median(abs(signed - m))')} AS sigma FROM deviations
    JOIN (SELECT scan_id, median(signed) AS m FROM deviations GROUP BY scan_id) USING (scan_id) GROUP BY scan_id"""))
def _(t):
    return robust_sigma(t.deviations, ["scan_id"], "signed").select("scan_id", r6(F.col("sigma")).alias("sigma"))
