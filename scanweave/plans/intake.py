"""Import of scans: scale, recentre, repair, drop small parts, optional reduction, tolerance."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions import snapping as sn
from scanweave.operators import mesh, repair as ops
from scanweave.plans.decimate import decimate
from scanweave.plans.repair import repair
from scanweave.session import cut


class Imported(NamedTuple):
    vertices: DataFrame
    faces: DataFrame
    counts: DataFrame
    origins: DataFrame


def scaled(vertices: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices in mm about the centre of their box, and the centres `(scan_id, scale, o*)`."""
    box = mesh.bounds(vertices).join(units, "scan_id")
    scale = sn.unit_scale(F.col("unit"))
    origin = cut(box.select("scan_id", scale.alias("scale"), *[((F.col(f"min_{c}") + F.col(f"max_{c}")) * scale / 2).alias(f"o{c}") for c in "xyz"]))
    moved = vertices.join(origin, "scan_id").select(
        "scan_id", "vertex_id", *[(F.col(c) * F.col("scale") - F.col(f"o{c}")).alias(c) for c in "xyz"])
    return moved, origin


def commit_import(vertices: DataFrame, faces: DataFrame, units: DataFrame, noise: DataFrame | None = None, reduce_by: float | None = None) -> Imported:
    """The working mesh of every scan. `units(scan_id, unit)`, `noise(scan_id, noise)` in mm."""
    moved, origin = scaled(vertices, units)
    moved = cut(moved)
    fixed = repair(moved, faces, ("degenerate", "duplicates", "winding", "orientation"))
    before = cut(fixed.faces)
    kept = cut(ops.without_small_parts(cut(ops.placed_faces(moved, before))).drop("near"))
    points = fixed.vertices
    if reduce_by is not None:
        points, kept, _ = decimate(points, kept, reduce_by)
    dropped = before.groupBy("scan_id").agg(F.count("*").alias("_b")).join(kept.groupBy("scan_id").agg(F.count("*").alias("_k")), "scan_id", "left")
    counts = fixed.counts.join(dropped, "scan_id").withColumn("removed_faces", F.col("_b") - F.coalesce("_k", F.lit(0))).drop("_b", "_k")
    given = noise if noise is not None else units.select("scan_id", F.lit(None).cast("double").alias("noise"))
    counts = counts.join(given, "scan_id", "left").withColumn("tolerance", sn.propose_tolerance(F.col("noise"))).drop("noise")
    return Imported(mesh.used_vertices(points, kept), kept, counts, origin)
