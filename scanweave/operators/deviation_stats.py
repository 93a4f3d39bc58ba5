"""Deviation statistics: summary, histogram, per-face numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators.quantiles import exact_percentiles

# Fixed values.
HISTOGRAM_BINS = 41
PASS_SHARE = 0.95


def deviation_stats(values: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """One row per key; NULL means no result and does not count.

    Mergeable sums need one pass; the percentiles come from two bracketed ones. A scan
    without any value keeps a row of NULLs.
    """
    keys = keys or ["scan_id"]
    v, size = F.col("signed"), F.abs("signed")
    share = lambda c: F.avg(F.when(v.isNotNull(), c.cast("double")))
    base = values.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("min"), F.max(v).alias("max"),
        share(size <= tolerance).alias("within"), share(v > tolerance).alias("above"),
        share(v < -tolerance).alias("below"),
    )
    signed = exact_percentiles(values, keys, "signed", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    absolute = exact_percentiles(values, keys, size, {"p99_abs": 0.99, "_p995": 0.995})
    limit = F.greatest(F.lit(3.0 * tolerance), F.coalesce("_p995", F.lit(0.0)))
    return (
        base.join(signed, keys, "left").join(absolute, keys, "left")
        .withColumn("histogram_limit", limit).drop("_p995")
        .withColumn("passed", F.coalesce(F.col("within") >= PASS_SHARE, F.lit(False)))
    )


def histogram(values: DataFrame, limits: DataFrame, keys: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per bin; values beyond the limit fall into the outer bins. Empty bins are absent."""
    keys = keys or ["scan_id"]
    limit = F.col("histogram_limit")
    clipped = F.least(F.greatest(F.col("signed"), -limit), limit)
    bin_ = F.least(F.floor((clipped + limit) * bins / (2 * limit)), F.lit(bins - 1))
    return (
        values.filter("signed IS NOT NULL").join(limits.select(*keys, "histogram_limit"), keys)
        .groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    )


def face_deviation(values: DataFrame, tolerance: float) -> DataFrame:
    """Statistics of the points whose closest point lies on one nominal face."""
    v, size = F.col("signed"), F.abs("signed")
    return values.filter(v.isNotNull() & F.col("face_id").isNotNull()).groupBy("scan_id", "body", "face_id").agg(
        F.count("*").alias("count"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"),
        F.max(size).alias("max_abs"), F.avg((size <= tolerance).cast("double")).alias("within"),
    )


def unsigned_summary(values: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Measured and total rows, rms, p95 (the value at index n * 0.95), largest, share within."""
    keys = keys or ["scan_id"]
    size = F.abs("signed")
    base = values.groupBy(*keys).agg(
        F.count(size).alias("measured"), F.count("*").alias("total"), F.sqrt(F.avg(size * size)).alias("rms"),
        F.max(size).alias("max"), F.avg(F.when(size.isNotNull(), (size <= tolerance).cast("double"))).alias("within"),
    )
    p95 = exact_percentiles(values, keys, size, {"p95": 0.95}, rank="index")
    return base.join(p95, keys, "left")


def face_means(values: DataFrame, faces: DataFrame) -> DataFrame:
    """Mean of the vertex values of every face; corners without a value are skipped."""
    corner = faces.select("scan_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return corner.join(values.select("scan_id", "vertex_id", "signed").hint("merge"), ["scan_id", "vertex_id"], "left").groupBy(
        "scan_id", "face_id"
    ).agg(F.avg("signed").alias("value"))


def measured_vertices(faces: DataFrame) -> DataFrame:
    """Vertices touched by a face that is not synthetic."""
    return faces.filter("NOT synthetic").select(
        "scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")
    ).distinct()
