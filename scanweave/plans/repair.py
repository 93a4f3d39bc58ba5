"""The repair job: weld, degenerate, duplicates, winding, orientation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators import mesh, repair as ops
from scanweave.session import cut

STEPS = ("weld", "degenerate", "duplicates", "winding", "orientation")


class Repaired(NamedTuple):
    vertices: DataFrame
    faces: DataFrame
    counts: DataFrame


def repair(vertices: DataFrame, faces: DataFrame, steps: tuple[str, ...] = STEPS) -> Repaired:
    """The repaired mesh and, per scan, the counts of every step."""
    counts: list[DataFrame] = []

    def count(df: DataFrame, name: str) -> None:
        counts.append(df.groupBy("scan_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)))

    if "weld" in steps:
        weld = cut(ops.weld_map(vertices))
        count(weld.filter("vertex_id <> kept_id"), "merged_vertices")
        faces = cut(ops.remap_corners(faces, weld))
        vertices = vertices.join(
            weld.filter("vertex_id = kept_id").select("scan_id", "vertex_id"), ["scan_id", "vertex_id"], "left_semi"
        )
    if "degenerate" in steps or "winding" in steps or "orientation" in steps:
        marks = cut(ops.marked_gathered(vertices, mesh.corners(vertices, faces, carry=["v0", "v1", "v2"])))
        faces = faces.join(marks, ["scan_id", "face_id"], "left")
        if "degenerate" in steps:
            count(marks.filter("degenerate"), "degenerate_faces")
            faces = faces.filter(~F.coalesce("degenerate", F.lit(False)))
        faces = faces.drop("degenerate")
    if "duplicates" in steps:
        before = cut(faces)
        faces = cut(ops.distinct_faces(before))
        count(ops.without(before, faces), "duplicate_faces")
    if "winding" in steps or "orientation" in steps:
        turned = cut(ops.winding(faces, mesh.face_pairs(faces, least=["near"])))
        faces = faces.join(turned, ["scan_id", "face_id"])
        if "winding" in steps:
            count(turned.filter("flip"), "flipped_faces")
            count(turned.filter("non_orientable"), "non_orientable_faces")
            faces = ops.reversed_faces(faces, F.col("flip"))
        faces = cut(faces.drop("flip", "non_orientable"))
        if "orientation" in steps:
            tri = mesh.corners(vertices, faces, carry=["part"])
            inverted = cut(ops.inverted_parts(tri, ["scan_id", "part"]).select("scan_id", "part", F.lit(True).alias("_in")))
            count(inverted, "inverted_parts")
            faces = faces.join(inverted, ["scan_id", "part"], "left")
            faces = ops.reversed_faces(faces, F.coalesce("_in", F.lit(False))).drop("_in")
        faces = faces.drop("part")
    faces = faces.drop("near")
    names = ["merged_vertices", "degenerate_faces", "duplicate_faces", "flipped_faces", "non_orientable_faces", "inverted_parts"]
    table = counts[0]
    for other in counts[1:]:
        table = table.unionByName(other)
    scans = faces.groupBy("scan_id").agg(F.count("*").alias("faces"))
    per_scan = table.groupBy("scan_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )
    return Repaired(
        mesh.used_vertices(vertices, faces), faces,
        scans.join(per_scan, "scan_id", "left").na.fill(0, names),
    )
