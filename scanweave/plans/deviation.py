"""Deviation map: signed distances of scan vertices from nominal surfaces, with statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators import deviation_stats as ds, mesh, spatial
from scanweave.session import cut, few


class DeviationMap(NamedTuple):
    vertices: DataFrame
    faces: DataFrame
    stats: DataFrame
    per_face: DataFrame


def reference_tables(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nominal triangles with coordinates, and their pseudo-normals, both written once."""
    carry = [c for c in faces.columns if c not in ("scan_id", "face_id")]
    tri = cut(mesh.face_geometry(mesh.corners(vertices, faces, carry)))
    normals = cut(spatial.feature_normals(faces, tri))
    return tri.withColumn("tri_id", F.col("face_id")), normals


def deviation_map(
    vertices: DataFrame, faces: DataFrame, tri: DataFrame, normals: DataFrame, tolerance: float,
    max_distance: float, cell: float | None = None,
) -> DeviationMap:
    """Deviation of every measured vertex; vertices of synthetic faces only get no value.

    `tri` carries `body` and `nominal_face` of every nominal triangle.
    """
    measured = vertices.join(ds.measured_vertices(faces).hint("merge"), ["scan_id", "vertex_id"], "left_semi")
    hits = spatial.signed_distances(measured, tri, normals, max_distance, cell)
    named = hits.join(tri.select("scan_id", "tri_id", "body", F.col("nominal_face").alias("face_id")).hint("merge"), ["scan_id", "tri_id"])
    values = cut(
        vertices.select("scan_id", "vertex_id").join(
            named.select("scan_id", "vertex_id", "signed", "body", "face_id").hint("merge"), ["scan_id", "vertex_id"], "left"
        )
    )
    return DeviationMap(values, ds.face_means(values, faces), ds.deviation_stats(values, tolerance), ds.face_deviation(values, tolerance))


def near_bodies(vertices: DataFrame, tri: DataFrame, max_distance: float) -> DataFrame:
    """Vertices inside the nominal box of their scan grown by the search distance."""
    box = tri.groupBy("scan_id").agg(
        *[F.min(F.least(*[F.col(f"{p}{c}") for p in "abc"])).alias(f"_lo{c}") for c in "xyz"],
        *[F.max(F.greatest(*[F.col(f"{p}{c}") for p in "abc"])).alias(f"_hi{c}") for c in "xyz"],
    )
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(F.col(f"_lo{c}") - max_distance, F.col(f"_hi{c}") + max_distance)
    return vertices.join(few(box), "scan_id").filter(inside).select(*vertices.columns)
