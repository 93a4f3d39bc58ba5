"""Mesh condition report per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators import mesh, repair as ops
from scanweave.operators.graph import stars, vertex_parts
from scanweave.session import cut


def boundary_loop_counts(faces: DataFrame | None = None, edge_table: DataFrame | None = None) -> DataFrame:
    """Boundary loops per scan: components of the boundary edges, simple or not.

    A graph has as many components as nodes minus the non-root nodes of its stars.
    """
    rim = cut(mesh.boundary(faces, edge_table).select("scan_id", F.col("src").alias("a"), F.col("dst").alias("b")))
    nodes = (
        rim.select("scan_id", F.explode(F.array("a", "b")).alias("n")).distinct()
        .groupBy("scan_id").agg(F.count("*").alias("_nodes"))
    )
    inner = stars(rim).groupBy("scan_id").agg(F.count("*").alias("_inner"))
    return nodes.join(inner, "scan_id", "left").select(
        "scan_id", (F.col("_nodes") - F.coalesce("_inner", F.lit(0))).alias("boundary_loops")
    )


def mesh_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per scan: counts, edges by valence, parts, defects, area, volume, size."""
    faces = cut(faces)
    tri = cut(mesh.corners(vertices, faces))
    edge_table = cut(mesh.edges(faces))
    edges = mesh.edge_counts(edge_table=edge_table)
    parts = cut(ops.part_sizes(vertex_parts(faces)))
    kept = ops.kept_parts(parts).groupBy("scan_id").agg(F.count("*").alias("_kept"))
    part_counts = parts.groupBy("scan_id").agg(F.count("*").alias("components"))
    shape = tri.groupBy("scan_id").agg(
        F.count("*").alias("face_count"), F.sum(mesh.face_cross().norm() * 0.5).alias("area"),
        F.count_if("synthetic").alias("synthetic_faces"),
    )
    size = mesh.bounds(vertices).select(
        "scan_id", *[(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"size_{c}") for c in "xyz"]
    )
    count = vertices.groupBy("scan_id").agg(F.count("*").alias("vertex_count"))
    flat = ops.degenerate_gathered(vertices, tri).groupBy("scan_id").agg(F.count("*").alias("degenerate_faces"))
    distinct = ops.distinct_faces(faces).groupBy("scan_id").agg(F.count("*").alias("_distinct"))
    volume = mesh.signed_volume(tri, vertices)
    row = shape
    for other in (count, edges, part_counts, kept, size, distinct, volume):
        row = row.join(other, "scan_id")
    row = row.join(boundary_loop_counts(edge_table=edge_table), "scan_id", "left").join(flat, "scan_id", "left")
    closed = F.col("edges") == F.col("manifold_edges")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return row.select(
        "scan_id", "face_count", "vertex_count", closed.alias("watertight"), zero("boundary_loops"),
        "boundary_edges", "non_manifold_edges", "inconsistent_edges", "components",
        (F.col("components") - F.col("_kept")).alias("small_parts"), zero("degenerate_faces"),
        (F.col("face_count") - F.col("_distinct")).alias("duplicate_faces"), "synthetic_faces", "area",
        F.when(closed, F.abs("volume")).alias("volume"), "size_x", "size_y", "size_z",
    )
