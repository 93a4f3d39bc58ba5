"""Intake of mesh files: verdicts, fingerprints, indexed tables, import report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import snapping as sn
from scanweave.operators import mesh, repair
from scanweave.sources.stl import SUFFIXES

# Fixed values.
METRES_BELOW_DIAGONAL = 2.0
MAX_WORKING_FACES = 2_000_000


def file_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file from its metadata: its suffix decides; contents are not read and any size is taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    verdict = F.when(~suffix.isin(*SUFFIXES), "unsupported_format").otherwise("ok")
    return files.select("path", "length", suffix.alias("suffix"), verdict.alias("verdict"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every source file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def indexed_mesh(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, triangles and rejected faces of indexed files; polygons become fans."""
    vertices = rows.filter("item = 'vertex'").select("scan_id", F.col("id").alias("vertex_id"), "x", "y", "z")
    polygons = rows.filter("item = 'face'").select("scan_id", "id", "corners")
    count = vertices.groupBy("scan_id").agg(F.count("*").alias("_n"))
    # Each polygon owns a range of ids as wide as the scan's largest fan.
    widest = polygons.groupBy("scan_id").agg(F.greatest(F.max(F.size("corners")), F.lit(1024)).alias("_wide"))
    checked = polygons.join(count, "scan_id", "left").join(widest, "scan_id")
    valid = (F.size("corners") >= 3) & F.forall("corners", lambda c: (c >= 0) & (c < F.coalesce("_n", F.lit(0))))
    fan = F.transform(F.sequence(F.lit(1), F.size("corners") - 2), lambda k: F.struct(
        F.get(F.col("corners"), F.lit(0)).alias("v0"), F.get(F.col("corners"), k).alias("v1"), F.get(F.col("corners"), k + 1).alias("v2")))
    faces = checked.filter(valid).select("scan_id", "id", "_wide", F.posexplode(fan).alias("_k", "_t")).select(
        "scan_id", (F.col("id") * F.col("_wide") + F.col("_k")).alias("face_id"), "_t.*", F.lit(False).alias("synthetic"))
    return vertices, faces, checked.filter(~valid).select("scan_id", F.col("id").alias("face_id"))


def import_report(soup: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Per scan: counts, bounds, suggested unit, merged vertices, dropped faces, reduction flag,
    and the proposed tolerance when `noise(scan_id, noise)` is given."""
    finite = repair.finite_faces(soup)
    vertices, faces = repair.soup_vertices(finite)
    kept = repair.weld_map(vertices)
    welded = kept.groupBy("scan_id").agg(
        F.count_if(F.col("vertex_id") == F.col("kept_id")).alias("vertex_count"),
        F.count_if(F.col("vertex_id") != F.col("kept_id")).alias("merged_vertices"))
    every = soup.groupBy("scan_id").agg(F.count("*").alias("_all"))
    count = faces.groupBy("scan_id").agg(F.count("*").alias("face_count"))
    row = count.join(welded, "scan_id").join(every, "scan_id").join(mesh.bounds(vertices), "scan_id")
    if noise is not None:
        row = row.join(noise, "scan_id", "left").withColumn("proposed_tolerance", sn.propose_tolerance(F.col("noise")))
    return row.withColumns({
        "non_finite_faces": F.col("_all") - F.col("face_count"),
        "suggested_unit": F.when(mesh.diagonal() < METRES_BELOW_DIAGONAL, "m").otherwise("mm"),
        "reduction_required": F.col("face_count") > MAX_WORKING_FACES,
    }).drop("_all")
