"""Fits of the analytic patches, compared with the surfaces they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6
from scanweave.plans import fits
from scanweave.registry import query

D = "::DOUBLE"


@query("a20_a24_start_fits")
def _(t):
    p = t.patch_points
    return fits.start_fits(p, fits.start_axes(p)).drop(*[f"{a}{c}" for a in "eg" for c in "xyz"])


# The true surface is known: the check states its size, the query the fitted one, both coarse.
@query("m01_fit_own_kind", sql(f"""SELECT scan_id, label, kind, CASE WHEN kind IN ('sphere', 'cylinder', 'torus') THEN round(radius, 1) END AS size,
    CASE WHEN kind = 'cone' THEN round(half_angle, 1) END AS angle, 1.0{D} AS up FROM primitives"""))
def _(t):
    own = fits.fit_own(t.patch_points, t.primitives)
    kind = F.col("kind")
    return own.select("scan_id", "label", "kind", F.when(kind.isin("sphere", "cylinder", "torus"), F.round("radius", 1)).alias("size"),
                      F.when(kind == "cone", F.round("half_angle", 1)).alias("angle"),
                      F.when(kind == "sphere", 1.0).otherwise(F.round(F.abs("nz"), 2)).alias("up"))


@query("m02_choose_kind", sql("SELECT scan_id, label, kind FROM primitives"))
def _(t):
    return fits.fit_best(t.patch_points, 0.012).select("scan_id", "label", "kind")


@query("t06_alternatives")
def _(t):
    return fits.fit_best(t.patch_points, 0.012).select("scan_id", "label", F.array_join("alternatives", ",").alias("alternatives"))


@query("a41_uncertainty")
def _(t):
    own = fits.fit_own(t.patch_points, t.primitives)
    return fits.uncertainties(t.patch_points, own)


@query("t04_sample_bound", sql("SELECT scan_id, label, true AS bounded FROM primitives"))
def _(t):
    s = fits.sample(t.patch_points, fits.KEY, 200, "point_id")
    n = t.patch_points.groupBy(*fits.KEY).agg(F.count("*").alias("n"))
    kept = s.groupBy(*fits.KEY).agg(F.count("*").alias("k")).join(n, fits.KEY)
    return kept.select(*fits.KEY, (F.abs(F.col("k") - F.least("n", F.lit(200))) < 80).alias("bounded"))
