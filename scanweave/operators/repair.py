"""Mesh repair: weld, degenerate and duplicate faces, winding, orientation, small parts.

Face ids never change, so the face map of every dropping step is the set of kept ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec
from scanweave.operators import mesh
from scanweave.operators.graph import near_by, stars, stars_near, vertex_parts
from scanweave.session import cut, few

# Fixed values.
WELD_GRID_BITS = 20
MIN_PART_RATIO = 0.01
MIN_PART_FACES = 100
ORIENTATION_CERTAINTY = 0.2


def finite_faces(soup: DataFrame) -> DataFrame:
    """Soup rows whose nine corner coordinates are all finite."""
    ok: Column = F.lit(True)
    for corner in "abc":
        for axis in "xyz":
            c = F.col(f"{corner}{axis}")
            ok = ok & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return soup.filter(ok)


def soup_vertices(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three new vertices per soup face: `3 * face_id + slot`."""
    rows = F.array(*[
        F.struct((F.col("face_id") * 3 + s).alias("vertex_id"), *[F.col(f"{n}{a}").alias(a) for a in "xyz"])
        for s, n in enumerate("abc")
    ])
    vertices = soup.select("scan_id", F.inline(rows))
    faces = soup.select("scan_id", "face_id", *[(F.col("face_id") * 3 + s).alias(f"v{s}") for s in range(3)])
    return vertices, faces


def weld_map(vertices: DataFrame) -> DataFrame:
    """`(scan_id, vertex_id, kept_id)`: the smallest vertex id of each weld cell."""
    box = few(mesh.bounds(vertices))
    extent = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    cells = (
        vertices.join(box, "scan_id")
        .withColumn("_cell", F.greatest(extent, F.lit(1e-12)) / float(1 << WELD_GRID_BITS))
        .select(
            "scan_id", "vertex_id",
            *[F.floor((F.col(c) - F.col(f"min_{c}")) / F.col("_cell")).alias(f"_{c}") for c in "xyz"],
        )
    )
    key = ["scan_id", "_x", "_y", "_z"]
    kept = cells.groupBy(*key).agg(F.min("vertex_id").alias("kept_id"))
    return cells.join(kept, key).select("scan_id", "vertex_id", "kept_id")


def remap_corners(faces: DataFrame, weld: DataFrame) -> DataFrame:
    """Faces with every corner replaced by its welded vertex, in one join."""
    rows = faces.select(
        *[c for c in faces.columns if c not in ("v0", "v1", "v2")],
        F.posexplode(F.array("v0", "v1", "v2")).alias("_slot", "vertex_id"),
    )
    keys = [c for c in rows.columns if c not in ("_slot", "vertex_id")]
    return rows.join(weld, ["scan_id", "vertex_id"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_slot") == s, F.col("kept_id"))).alias(f"v{s}") for s in range(3)]
    )


def degenerate_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with a repeated corner or (numerically) no area."""
    return degenerate_gathered(vertices, mesh.corners(vertices, faces, carry=["v0", "v1", "v2"]))


def degenerate_gathered(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """The same for faces whose corners are already gathered."""
    return marked_gathered(vertices, tri).filter("degenerate").select("scan_id", "face_id")


def marked_gathered(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """Gathered faces: whether they are degenerate and where they stand (`near`)."""
    box = few(mesh.bounds(vertices))
    repeated = (F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))
    flat = mesh.face_cross().norm() <= 2.0 * F.pow(1e-9 * mesh.diagonal(), 2)
    return mesh.placed(tri.join(box, "scan_id"), "a").select(
        "scan_id", "face_id", F.coalesce(repeated | flat, F.lit(False)).alias("degenerate"), "near")


def placed_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the place of their first corner (`near`), by which components meet."""
    at = vertices.groupBy("scan_id", F.col("vertex_id").alias("v0")).agg(*[F.min(c).alias(c) for c in "xyz"])
    rows = faces.join(at, ["scan_id", "v0"], "left").join(few(mesh.bounds(vertices)), "scan_id", "left")
    return mesh.placed(rows).select(*faces.columns, "near")


def without(faces: DataFrame, removed: DataFrame) -> DataFrame:
    return faces.join(removed, ["scan_id", "face_id"], "left_anti")


def distinct_faces(faces: DataFrame) -> DataFrame:
    """The face with the smallest id per vertex set; copies merge before the shuffle."""
    low, high = F.least("v0", "v1", "v2"), F.greatest("v0", "v1", "v2")
    key = [low.alias("_k0"), (F.col("v0") + F.col("v1") + F.col("v2") - low - high).alias("_k1"), high.alias("_k2")]
    rest = [c for c in faces.columns if c not in ("scan_id", "face_id")]
    return (
        faces.groupBy("scan_id", *key)
        .agg(F.min("face_id").alias("face_id"), *[F.min_by(c, "face_id").alias(c) for c in rest])
        .select(*faces.columns)
    )


def reversed_faces(faces: DataFrame, flip: Column) -> DataFrame:
    swap = {"v0": F.when(flip, F.col("v2")).otherwise(F.col("v0")),
            "v2": F.when(flip, F.col("v0")).otherwise(F.col("v2"))}
    return faces.withColumns(swap)


def winding(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per face: its part, whether it disagrees with the majority, and non-orientable ones.

    Components run on a double cover: node `2 f` is face f as it is, `2 f + 1` the face
    turned over. Pairs that tell their place (`near`) are met by it. A part's smallest face is also the smallest node of its component, so
    the cover labels give the parts as well.
    """
    a0, b0 = 2 * F.col("fa"), 2 * F.col("fb")
    odd = F.when(F.col("consistent"), 0).otherwise(1)
    sides = F.array(F.struct(a0.alias("a"), (b0 + odd).alias("b")), F.struct((a0 + 1).alias("a"), (b0 + 1 - odd).alias("b")))
    if "near" in pairs.columns:
        pairs = near_by(cut(pairs.select("scan_id", "fa", "fb", "consistent", "near")), "near", edges=2)
        found = stars_near(pairs.select("scan_id", F.inline(sides)))
    else:
        found = stars(pairs.select("scan_id", F.inline(sides)))
    # A node that is not found is the smallest of its component itself.
    no = F.lit(None).cast("long")
    as_is = F.col("a") % 2 == 0
    roots = faces.select("scan_id", "face_id", no.alias("_c0"), no.alias("_c1")).unionByName(found.select(
        "scan_id", F.floor(F.col("a") / 2).alias("face_id"), F.when(as_is, F.col("b")).alias("_c0"), F.when(~as_is, F.col("b")).alias("_c1")))
    c0, c1 = F.coalesce("_c0", 2 * F.col("face_id")), F.coalesce("_c1", 2 * F.col("face_id") + 1)
    per_face = cut(
        roots.groupBy("scan_id", "face_id").agg(F.max("_c0").alias("_c0"), F.max("_c1").alias("_c1"))
        .select("scan_id", "face_id", c0.alias("_c0"), c1.alias("_c1"))
        .select(
            "scan_id", "face_id", F.floor(F.least("_c0", "_c1") / 2).alias("part"),
            (F.col("_c0") == F.col("_c1")).alias("non_orientable"),
            (F.col("_c1") < F.col("_c0")).alias("_against"),
        )
    )
    votes = per_face.groupBy("scan_id", "part").agg(
        F.count_if(F.col("_against")).alias("_no"), F.count_if(~F.col("non_orientable")).alias("_all")
    )
    flip = ~F.col("non_orientable") & (F.col("_against") != (F.col("_no") > F.col("_all") / 2))
    return per_face.join(few(votes), ["scan_id", "part"]).select(
        "scan_id", "face_id", "part", flip.alias("flip"), "non_orientable"
    )


def inverted_parts(tri: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose signed volume about their centroid is clearly negative.

    `tri` holds gathered corners and the part columns named in `keys`.
    """
    a, b, c = mesh.face_vectors()
    centre = tri.groupBy(*keys).agg(*[F.avg(s).alias(f"m{n}") for n, s in zip("xyz", (a + b + c) / 3.0)])
    m = vec("m")
    share = (a - m).dot((b - m).cross(c - m))
    sums = tri.join(centre, keys).groupBy(*keys).agg(
        (F.sum(share) / 6).alias("volume"), (F.sum(F.abs(share)) / 6).alias("spread")
    )
    return sums.filter(
        (F.col("volume") < 0) & (F.abs("volume") >= ORIENTATION_CERTAINTY * F.col("spread"))
    )


def part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("scan_id", "part").agg(F.count("*").alias("faces"))


def kept_parts(
    sizes: DataFrame, ratio: float = MIN_PART_RATIO, min_faces: int = MIN_PART_FACES
) -> DataFrame:
    """Parts that reach both limits; the largest part of a scan always does."""
    largest = sizes.groupBy("scan_id").agg(F.max("faces").alias("_largest"))
    limit = F.least(F.greatest(F.lit(float(min_faces)), ratio * F.col("_largest")), F.col("_largest"))
    return sizes.join(largest, "scan_id").filter(F.col("faces") >= limit).drop("_largest")


def without_small_parts(faces: DataFrame, ratio: float = MIN_PART_RATIO, min_faces: int = MIN_PART_FACES) -> DataFrame:
    parts = vertex_parts(faces)
    kept = parts.join(kept_parts(part_sizes(parts), ratio, min_faces), ["scan_id", "part"], "left_semi")
    return faces.join(kept, ["scan_id", "face_id"], "left_semi")
