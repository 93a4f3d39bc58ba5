"""Files written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.functions.vec import r6
from scanweave.operators import mesh
from scanweave.registry import query
from scanweave.session import checkpoint_root
from scanweave.sources import intake, stl

C9 = [f"{c}{a}" for c in "abc" for a in "xyz"]


def folder(t, name: str) -> str:
    stl.register(t.spark)
    return f"{checkpoint_root(t.spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def soup(t):
    return mesh.corners(t.vertices, t.faces, carry=[])


def written(t) -> str:
    path = folder(t, "stl")
    soup(t).select("scan_id", "face_id", *C9).write.format("scan_stl").mode("append").save(path)
    return path


_F32 = lambda c: f"(({c})::FLOAT)::DOUBLE"


@query("s02_binary_stl", sql(f"""SELECT scan_id, count(*) AS faces, {r(f"sum({_F32('ax')} + {_F32('by_')} + {_F32('cz')})", 4)} AS total, {r(f"max({_F32('cz')})")} AS top FROM tri GROUP BY scan_id"""))
def _(t):
    back = t.spark.read.format("scan_stl").option("recordsPerSplit", "5000").load(written(t))
    return back.groupBy("scan_id").agg(F.count("*").alias("faces"), r6(F.sum(F.col("ax") + F.col("by") + F.col("cz")), 4).alias("total"), r6(F.max("cz")).alias("top"))


@query("s09_stl_round_trip", sql(f"SELECT scan_id, {', '.join(f'{r(_F32(c))} AS {c}' for c in C9 if c != 'by')}, {r(_F32('by_'))} AS \"by\" FROM tri"))
def _(t):
    back = t.spark.read.format("scan_stl").load(written(t))
    return back.select("scan_id", *[r6(F.col(c)).alias(c) for c in C9])


@query("s03_ascii_stl", sql(f"SELECT {', '.join(f'{r(_F32(c))} AS {c}' for c in C9 if c != 'by')}, {r(_F32('by_'))} AS \"by\" FROM tri"))
def _(t):
    path = folder(t, "ascii")
    lines = [F.lit("facet normal 0 0 1"), F.lit("outer loop"), *[F.concat_ws(" ", F.lit("vertex"), *[F.col(f"{c}{a}").cast("string") for a in "xyz"]) for c in "abc"],
             F.lit("endloop"), F.lit("endfacet")]
    # Every part file is a text file of its own; the first line names the solid.
    text = soup(t).select(F.concat_ws("\n", F.lit("solid part"), *lines, F.lit("endsolid part")).alias("value"))
    text.write.option("lineSep", "\n").text(path)
    back = t.spark.read.format("scan_stl").load(f"{path}/*.txt")
    return back.select(*[r6(F.col(c)).alias(c) for c in C9])


@query("s01_file_verdicts", sql("SELECT scan_id, 'ok' AS verdict, 84 + 50 * count(*) AS bytes FROM faces GROUP BY scan_id"))
def _(t):
    v = intake.file_verdicts(t.spark, written(t))
    scan = F.regexp_extract("path", r"([^/]+)\.part-\d+\.stl$", 1)
    # Parts of a scan repeat the 84-byte header; the sizes are compared without it.
    return v.groupBy(scan.alias("scan_id"), "verdict").agg((F.sum(F.col("length") - 84) + 84).alias("bytes"))


@query("s07_fingerprints")
def _(t):
    return intake.fingerprints(t.spark, written(t)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")


@query("s08_import_report", sql(f"""SELECT scan_id, n AS face_count, vc AS vertex_count, 3 * n - vc AS merged_vertices, dropped AS non_finite_faces, 'mm' AS suggested_unit, false AS reduction_required,
    min_x, max_x, {r('max_z')} AS max_z FROM (SELECT scan_id, count(*) AS n, min(least(ax, bx, cx)) AS min_x, max(greatest(ax, bx, cx)) AS max_x, max(greatest(az, bz, cz)) AS max_z FROM ok GROUP BY scan_id)
    JOIN (SELECT scan_id, count(*) - count(*) FILTER (isfinite(ax) AND isfinite(cz)) AS dropped FROM soup GROUP BY scan_id) USING (scan_id)
    JOIN (SELECT scan_id, count(DISTINCT v) AS vc FROM (SELECT scan_id, unnest([v0, v1, v2]) AS v FROM faces JOIN ok USING (scan_id, face_id)) GROUP BY scan_id) USING (scan_id)""",
    ok="SELECT * FROM soup WHERE isfinite(ax) AND isfinite(cz)"))
def _(t):
    rep = intake.import_report(t.soup)
    return rep.select("scan_id", "face_count", "vertex_count", "merged_vertices", "non_finite_faces", "suggested_unit", "reduction_required", "min_x", "max_x", r6(F.col("max_z")).alias("max_z"))
