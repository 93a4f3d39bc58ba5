"""Classes, trimmed fits, snapped radii, bolt circles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import sql
from scanweave.fixtures import scan_name
from scanweave.operators import patterns
from scanweave.plans import fits, quality
from scanweave.registry import query


@query("m07_classify_regions", sql("SELECT scan_id, label, kind FROM primitives"))
def _(t):
    return quality.classify(t.patch_points, 0.012).select("scan_id", "label", "kind")


@query("f11_trimmed_fit", sql("SELECT scan_id, label, kind FROM primitives"))
def _(t):
    return quality.trimmed_fit(t.patch_points, t.primitives, 0.004).select("scan_id", "label", "kind")


# Every round surface has a whole-number radius, well inside the snap window.
@query("m05_snap_radius", sql("SELECT scan_id, label, kind, radius AS value FROM primitives WHERE kind IN ('sphere', 'cylinder')"))
def _(t):
    round_ = t.primitives.filter("kind IN ('sphere', 'cylinder')")
    own = fits.fit_own(t.patch_points, round_)
    return quality.snap_radius(t.patch_points, own).select("scan_id", "label", "kind", "value")


# Per region of 25 customers: holes of one radius on a circle, every 8th place; some are missing.
@query("w09_bolt_circles", sql("""SELECT scan_id, count(*) AS holes, 8 AS places, count(*) = 8 AS complete FROM (SELECT 'scan_' || (c_custkey // 8) AS scan_id, c_custkey % 8 AS slot FROM customer
    WHERE NOT (c_custkey // 8 % 3 = 1 AND c_custkey % 8 IN (6, 7))) GROUP BY scan_id HAVING count(*) >= 6"""))
def _(t):
    k = F.col("c_custkey")
    group, slot = F.floor(k / 8), k % 8
    angle = slot * 0.7853981633974483 + group % 5 * 0.1
    rows = t.read("customer").filter(~((group % 3 == 1) & slot.isin(6, 7))).select(
        F.concat(F.lit("scan_"), group.cast("string")).alias("scan_id"), k.alias("entity_id"), (30 * F.cos(angle) + group % 7).alias("cx"),
        (30 * F.sin(angle) - group % 11).alias("cy"), (F.lit(4.0) + slot * 0.01).alias("radius"))
    found = patterns.bolt_circles(rows, 0.05, 0.05).filter("holes >= 6")
    return found.select("scan_id", "holes", "places", "complete")
