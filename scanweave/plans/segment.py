"""Segment scans into regions of single primitives.

Parallel rounds over all scans: smooth parts become first regions, every region is fitted, free
faces are filled in, borders move to where primitives meet, badly explained patches become
regions, neighbours one primitive explains are merged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.primitives import signed_distance
from scanweave.functions.vec import V, vec
from scanweave.operators import mesh, regions, segmentation as seg
from scanweave.operators.graph import components
from scanweave.operators.quantiles import robust_sigma
from scanweave.plans import fits as ft
from scanweave.session import cut

KEY = ["scan_id", "face_id"]

# Fixed values.
RESIDUAL_ACCEPT = 1.5
MIN_RESIDUAL_AREA = 2.0
MAX_ANGLE_DEG = 10.0


class Segmented(NamedTuple):
    labels: DataFrame
    fits: DataFrame


def tuning(sensitivity: float) -> tuple[float, float]:
    """Growth tolerance and merge limit as multiples of the noise, for 0 … 100."""
    s = min(max(sensitivity, 0.0), 100.0) / 100.0
    return 6.0 - 4.0 * s, 1.8 - s


def region_points(labels: DataFrame, faces: DataFrame, normals: DataFrame) -> DataFrame:
    """Vertices of the faces of every region with their normals, once per region."""
    corner = faces.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    own = labels.filter("label > 0").join(corner, KEY).select("scan_id", F.col("label").cast("int").alias("label"), "vertex_id").distinct()
    return own.join(normals, ["scan_id", "vertex_id"]).withColumnRenamed("vertex_id", "point_id")


def _numbered(parts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Parts renamed to small labels per scan, after the labels already in use."""
    from pyspark.sql import Window as W

    own = parts.select("scan_id", "part").distinct().withColumn("_k", F.row_number().over(W.partitionBy("scan_id").orderBy("part")))
    if base is not None:
        used = base.groupBy("scan_id").agg(F.max("label").alias("_top"))
        own = own.join(used, "scan_id", "left").withColumn("_k", F.col("_k") + F.coalesce("_top", F.lit(0)))
    return parts.join(own.select("scan_id", "part", F.col("_k").cast("int").alias("label")), ["scan_id", "part"]).select(*KEY, "label")


def first_regions(faces: DataFrame, pairs: DataFrame, geometry: DataFrame, min_area: float) -> DataFrame:
    """Parts connected across edges that bend by less than 10 degrees, of at least `min_area`."""
    smooth = cut(seg.smooth_pairs(pairs, geometry, MAX_ANGLE_DEG))
    parts = cut(components(faces.filter("NOT synthetic").select(*KEY), smooth.select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b"))))
    large = parts.join(geometry, KEY).groupBy("scan_id", "part").agg(F.sum("area").alias("_a")).filter(F.col("_a") >= min_area)
    named = _numbered(parts.join(large, ["scan_id", "part"], "left_semi"))
    return faces.select(*KEY).join(named, KEY, "left").select(*KEY, F.coalesce("label", F.lit(0)).alias("label"))


def unexplained(labels: DataFrame, fits: DataFrame, pairs: DataFrame, geometry: DataFrame, tolerance: float, min_area: float) -> DataFrame:
    """Connected faces farther from their primitive than the tolerance, as new labels."""
    p = V(F.col("gx"), F.col("gy"), F.col("gz"))
    at = labels.join(geometry.select(*KEY, "gx", "gy", "gz"), KEY).join(fits.select(*ft.FIT, *[f"{a}{c}" for a in "on" for c in "xyz"], *ft._SIZES), ["scan_id", "label"])
    bad = cut(at.filter(F.abs(signed_distance(p)) > tolerance).select(*KEY))
    links = pairs
    for side in ("fa", "fb"):
        links = links.join(bad.withColumnRenamed("face_id", side), ["scan_id", side], "left_semi")
    parts = components(bad, links.select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b")))
    large = parts.join(geometry, KEY).groupBy("scan_id", "part").agg(F.sum("area").alias("_a")).filter(F.col("_a") >= max(min_area, MIN_RESIDUAL_AREA))
    return _numbered(parts.join(large, ["scan_id", "part"], "left_semi"), labels)


def relabelled(labels: DataFrame, change: DataFrame) -> DataFrame:
    new = change.withColumnRenamed("label", "_new")
    return labels.join(new, KEY, "left").select(*KEY, F.coalesce("_new", "label").cast("int").alias("label"))


def merge_round(labels: DataFrame, fits: DataFrame, points: DataFrame, pairs: DataFrame, limit: float, rejected: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One round of merging: `(moves, tried)`.

    Every region proposes the neighbour it shares most edges with; mutual proposals are refitted
    together, and merged when both halves stay below the limit.
    """
    near = regions.adjacency(labels, pairs)
    if rejected is not None:
        near = near.join(rejected, ["scan_id", "low", "high"], "left_anti")
    near = cut(near)
    sides = near.select("scan_id", "low", "high", "shared_edges", F.explode(F.array("low", "high")).alias("me"))
    order = F.struct("shared_edges", -F.col("low"), -F.col("high"))
    wish = sides.groupBy("scan_id", "me").agg(F.max_by(F.struct("low", "high"), order).alias("_w")).select("scan_id", "me", "_w.*")
    mutual = cut(wish.groupBy("scan_id", "low", "high").agg(F.count("*").alias("_n")).filter("_n = 2").drop("_n"))
    part = mutual.select("scan_id", "low", "high", F.explode(F.array("low", "high")).alias("label"))
    both = cut(points.join(part, ["scan_id", "label"]).withColumnsRenamed({"label": "_own", "low": "label"}))
    kinds = mutual.join(fits.select("scan_id", F.col("label").alias("low"), "kind"), ["scan_id", "low"])
    union = ft.fit_own(both, kinds.select("scan_id", F.col("low").alias("label"), "kind"))
    shape = union.select(*ft.FIT, *[f"{a}{c}" for a in "on" for c in "xyz"], *ft._SIZES)
    rows = both.select("scan_id", "label", "high", "_own", "x", "y", "z").join(shape, ft.KEY).withColumn("_r", signed_distance(vec()))
    sigma = robust_sigma(cut(rows.select("scan_id", "label", "high", "_own", "_r")), ["scan_id", "label", "high", "_own"], "_r")
    good = sigma.groupBy("scan_id", "label", "high").agg(F.max("sigma").alias("_s")).filter(F.col("_s") < limit)
    moves = cut(good.select("scan_id", F.col("high").alias("label"), F.col("label").alias("target")))
    return moves, mutual


def segment(vertices: DataFrame, faces: DataFrame, noise: float, sensitivity: float = 50.0, min_area: float = 1.0) -> Segmented:
    """Labels per face (0 = none), largest region first, and the fit of every region."""
    grow, merge = tuning(sensitivity)
    faces = cut(faces)
    tri = cut(mesh.corners(vertices, faces))
    geometry = cut(mesh.face_geometry(tri).select(*KEY, "area", *[f"{a}{c}" for a in "gn" for c in "xyz"]))
    normals = cut(mesh.vertex_normals(vertices, tri))
    pairs = cut(mesh.face_pairs(faces))
    links = cut(mesh.neighbours(pairs))
    unit = geometry.select(*KEY, "nx", "ny", "nz")
    centre = geometry.select(*KEY, "gx", "gy", "gz")

    def fit(labels: DataFrame) -> DataFrame:
        points = cut(region_points(labels, faces, normals))
        large = points.groupBy(*ft.KEY).agg(F.count("*").alias("_n")).filter("_n >= 8")
        return cut(ft.fit_best(points.join(large, ft.KEY, "left_semi"), noise))

    def relax(labels: DataFrame, found: DataFrame) -> DataFrame:
        shape = found.select(*ft.FIT, *[f"{a}{c}" for a in "on" for c in "xyz"], *ft._SIZES)
        return seg.relax_boundaries(labels, links, centre, shape)

    labels = cut(first_regions(faces, pairs, geometry, min_area))
    labels = cut(seg.fill_unassigned(labels, links, unit, centre))
    found = fit(labels)
    labels = relax(labels, found)
    extra = cut(unexplained(labels, found, pairs, geometry, grow * noise, min_area))
    if not extra.isEmpty():
        good = fit(extra).filter(F.col("sigma") < RESIDUAL_ACCEPT * noise).select("scan_id", "label")
        labels = cut(relabelled(labels, extra.join(good, ["scan_id", "label"], "left_semi")))
        found = fit(labels)
    rejected: DataFrame | None = None
    # Ends: a round merges regions or rejects pairs, and there are finitely many of both.
    while True:
        points = cut(region_points(labels, faces, normals))
        moves, tried = merge_round(labels, found, points, pairs, merge * noise, rejected)
        if tried.isEmpty():
            break
        lost = tried.join(moves.select("scan_id", F.col("target").alias("low"), F.col("label").alias("high")), ["scan_id", "low", "high"], "left_anti")
        rejected = cut(lost if rejected is None else rejected.unionByName(lost))
        if not moves.isEmpty():
            labels = cut(labels.join(moves, ["scan_id", "label"], "left").select(*KEY, F.coalesce("target", "label").cast("int").alias("label")))
            found = fit(labels)
    labels = relax(labels, found)
    labels = cut(regions.compact_labels(labels))
    return Segmented(labels, fit(labels))
