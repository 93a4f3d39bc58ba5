"""Reduce meshes by clustering vertices on a grid, with an approximate face map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators import mesh, repair, spatial
from scanweave.session import cut


def cluster(vertices: DataFrame, faces: DataFrame, cell) -> tuple[DataFrame, DataFrame]:
    """Vertices of one cell merge into their mean; collapsed and duplicate faces disappear."""
    placed = spatial.with_cell(vertices, cell)
    merged = placed.groupBy("scan_id", *spatial.CELL).agg(
        F.min("vertex_id").alias("kept_id"), *[F.avg(c).alias(c) for c in "xyz"])
    weld = placed.select("scan_id", "vertex_id", *spatial.CELL).join(merged, ["scan_id", *spatial.CELL]).select("scan_id", "vertex_id", "kept_id")
    moved = repair.remap_corners(faces.select("scan_id", "face_id", "v0", "v1", "v2", "synthetic"), weld)
    solid = moved.filter("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    return merged.select("scan_id", F.col("kept_id").alias("vertex_id"), "x", "y", "z"), repair.distinct_faces(solid)


def decimate(vertices: DataFrame, faces: DataFrame, reduce_by: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """At most 1 / `reduce_by` of the faces per scan: vertices, faces, and `new_face -> old_face`.

    The cell grows until every scan is small enough; the first guess follows from the mean
    face area. A scan that stays too large when one cell spans it cannot be reduced so far and
    raises. Vertices no face uses go. The map takes the old face with the nearest centroid.
    """
    faces = cut(faces)
    span = vertices.groupBy("scan_id").agg(F.max(F.greatest(*[F.abs(c) for c in "xyz"])).alias("_span"))
    before = faces.groupBy("scan_id").agg(F.count("*").alias("_before"))
    tri = cut(mesh.corners(vertices, faces, carry=[]))
    area = tri.groupBy("scan_id").agg(F.avg(mesh.face_cross().norm() * 0.5).alias("_area"))
    size = cut(area.join(span, "scan_id").select("scan_id", F.sqrt(2.0 * F.col("_area") * reduce_by).alias("_cell"), "_span"))
    while True:
        low, kept = cluster(vertices.join(size.drop("_span"), "scan_id"), faces, F.col("_cell"))
        low, kept = cut(low), cut(kept)
        after = kept.groupBy("scan_id").agg(F.count("*").alias("_after"))
        heavy = cut(before.join(after, "scan_id").filter(F.col("_after") * reduce_by > F.col("_before")).select("scan_id"))
        if heavy.isEmpty():
            break
        if not heavy.join(size, "scan_id").filter(F.col("_cell") > 4 * F.col("_span")).isEmpty():
            raise ValueError("a scan cannot be reduced that far")
        grown = F.when(F.col("_heavy"), F.col("_cell") * 1.25).otherwise(F.col("_cell"))
        size = cut(size.join(heavy.withColumn("_heavy", F.lit(True)), "scan_id", "left").select("scan_id", grown.alias("_cell"), "_span"))
    corner = kept.select("scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    low = cut(low.join(corner.distinct(), ["scan_id", "vertex_id"], "left_semi"))
    centre = lambda t, i: mesh.face_geometry(t).select("scan_id", F.col("face_id").alias(i), *[F.col(f"g{c}").alias(c) for c in "xyz"])
    hit = spatial.nearest(centre(mesh.corners(low, kept, carry=[]), "q_id"), centre(tri, "t_id"))
    return low, kept, hit.select("scan_id", F.col("q_id").alias("new_face"), F.col("t_id").alias("old_face"))
