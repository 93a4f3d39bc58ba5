"""Trimmed fits, region classes and snapped sizes on top of the primitive fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.primitives import signed_distance
from scanweave.functions.snapping import snap_length
from scanweave.functions.vec import vec
from scanweave.operators.quantiles import robust_sigma
from scanweave.plans import fits as ft
from scanweave.session import cut

# Fixed values.
MIN_FIT_POINTS = 200
CLASS_FACTOR = 2.0
MAX_RMS_RISE = 1.05


def trimmed_fit(points: DataFrame, kinds: DataFrame, noise: float) -> DataFrame:
    """Fit, drop points beyond max(3 robust sigma, 2 noise), fit again.

    Regions that would keep fewer than 200 points, or all of them, keep the first fit.
    """
    first = cut(ft.fit_own(points, kinds))
    shape = first.select(*ft.FIT, *[f"{a}{c}" for a in "on" for c in "xyz"], *ft._SIZES)
    own = points.select(*ft.KEY, "point_id", "x", "y", "z", F.struct("nx", "ny", "nz").alias("_n"))
    rows = own.join(shape, ft.KEY).withColumn("_r", F.abs(signed_distance(vec())))
    rows = cut(rows.select(*ft.KEY, "point_id", "x", "y", "z", "_n", "_r"))
    limit = robust_sigma(rows, ft.KEY, "_r").select(*ft.KEY, F.greatest(3 * F.col("sigma"), F.lit(2 * noise)).alias("_limit"))
    marked = rows.join(limit, ft.KEY).withColumn("_keep", F.col("_r") <= F.col("_limit"))
    counts = marked.groupBy(*ft.KEY).agg(F.count_if("_keep").alias("_k"), F.count("*").alias("_n_all"))
    again = cut(counts.filter((F.col("_k") >= MIN_FIT_POINTS) & (F.col("_k") < F.col("_n_all"))).select(*ft.KEY))
    kept = marked.filter("_keep").join(again, ft.KEY, "left_semi").select(*ft.KEY, "point_id", "x", "y", "z", "_n.*")
    second = ft.fit_own(kept, kinds)
    return first.join(again, ft.KEY, "left_anti").unionByName(second.select(*first.columns))


def classify(points: DataFrame, noise: float) -> DataFrame:
    """Kind and rms per region; `unknown` when even the best fit scatters by more than 2 x noise."""
    best = ft.fit_best(points, noise)
    good = F.col("sigma") <= CLASS_FACTOR * noise
    return best.select(*ft.KEY, F.when(good, F.col("kind")).otherwise("unknown").alias("kind"), F.when(good, F.col("rms")).alias("rms"))


def snap_radius(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Radius of spheres and cylinders snapped to a design value and the rest refitted.

    The snap stays when the rms rises by at most five percent.
    """
    round_ = cut(fits.filter(F.col("kind").isin("sphere", "cylinder")))
    error = ft.uncertainties(points, round_.select(*ft.FIT, *ft._FRAME, *ft._SIZES)).select(*ft.FIT, F.col("size").alias("_u"))
    wanted = round_.join(error, ft.FIT).withColumn("_s", snap_length(F.col("radius"), F.col("_u"))).filter("_s IS NOT NULL")
    fixed = cut(wanted.select(*ft.FIT, *ft._FRAME, F.col("_s.value").alias("radius"), "minor_radius", "half_angle"))
    tried = ft.with_quality(points, ft.refine(points, fixed, frozen=frozenset({5})))
    before = round_.select(*ft.FIT, F.col("radius").alias("measured"), F.col("rms").alias("_rms"))
    return tried.join(before, ft.FIT).filter(F.col("rms") <= MAX_RMS_RISE * F.col("_rms")).select(
        *ft.FIT, "measured", F.col("radius").alias("value"), "rms")
