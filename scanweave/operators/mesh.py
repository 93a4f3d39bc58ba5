"""Corner gather, half-edges, face pairs and measures of triangle meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec
from scanweave.session import cut, few

KEY = ["scan_id", "face_id"]
# Fixed values.
PLACE_BITS = 10


def corners(vertices: DataFrame, faces: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Faces with the coordinates of their corners: `ax … cz`.

    The three corners of a face go through one equi-join on the vertex key and come
    back together in one aggregation, so neither side is shuffled three times.
    Faces with a missing vertex are dropped. Both sides grow with the mesh and compress well
    in a shuffle, so they are merged at every size: a broadcast is unpacked in the driver.
    """
    carry = [c for c in faces.columns if c not in KEY] if carry is None else carry
    rows = faces.select(
        *KEY, *carry, F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vertex_id")
    )
    found = rows.join(vertices.select("scan_id", "vertex_id", "x", "y", "z").hint("merge"), ["scan_id", "vertex_id"])
    picks = [
        F.max(F.when(F.col("slot") == slot, F.col(axis))).alias(f"{name}{axis}")
        for slot, name in enumerate("abc")
        for axis in "xyz"
    ]
    # `first` is safe: the carried columns depend on the face alone.
    return (
        found.groupBy(*KEY)
        .agg(*[F.first(c).alias(c) for c in carry], *picks, F.count("*").alias("_n"))
        .filter(F.col("_n") == 3)
        .drop("_n")
    )


def face_vectors() -> tuple[V, V, V]:
    return vec("a"), vec("b"), vec("c")


def face_cross() -> V:
    """Twice the area vector of the triangle in `ax … cz`."""
    a, b, c = face_vectors()
    return (b - a).cross(c - a)


def face_geometry(tri: DataFrame) -> DataFrame:
    """Unit normal `n*`, area and centroid `g*` of gathered faces; flat faces get no normal."""
    a, b, c = face_vectors()
    k = face_cross()
    doubled = F.greatest(k.norm(), F.lit(1e-300))
    return tri.select(
        "*", *(k / doubled).named("n"), (k.norm() * 0.5).alias("area"),
        *((a + b + c) / 3.0).named("g"),
    )


def half_edges(faces: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Directed half-edges with their undirected key `(lo, hi)`."""
    slots = F.array(*[
        F.struct(F.lit(s).alias("slot"), F.col(f"v{s}").alias("src"), F.col(f"v{(s + 1) % 3}").alias("dst"))
        for s in range(3)
    ])
    return faces.select(*KEY, *(carry or []), F.inline(slots)).select(
        "*", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    )


def edges(faces: DataFrame, least: list[str] | None = None) -> DataFrame:
    """Undirected edges with valence; an edge run is one aggregation, not a self-join.

    `least` names face columns of which an edge keeps the smallest value.

    A half-edge is one number (three times the face plus the slot), so the smallest and the
    largest one of an edge and their start vertices stay in primitive hash buffers.
    """
    half = F.col("face_id") * 3 + F.col("slot")
    least = least or []
    rows = half_edges(faces, least).select("scan_id", "lo", "hi", "src", half.alias("_half"), *least)
    merged = rows.groupBy("scan_id", "lo", "hi").agg(
        F.count("*").alias("valence"), F.min("_half").alias("_a"), F.max("_half").alias("_b"),
        F.min_by("src", "_half").alias("src"), F.max_by("src", "_half").alias("_other"), *[F.min(c).alias(c) for c in least],
    )
    return merged.select(
        "scan_id", "lo", "hi", "valence",
        F.floor(F.col("_a") / 3).alias("fa"), F.pmod("_a", F.lit(3)).cast("int").alias("slot_a"),
        F.floor(F.col("_b") / 3).alias("fb"), F.pmod("_b", F.lit(3)).cast("int").alias("slot_b"),
        "src", (F.col("lo") + F.col("hi") - F.col("src")).alias("dst"),
        (F.col("src") != F.col("_other")).alias("consistent"), *least,
    )


def face_pairs(faces: DataFrame, least: list[str] | None = None) -> DataFrame:
    """Faces adjacent across an edge of exactly two faces."""
    return edges(faces, least).filter(F.col("valence") == 2).drop("valence", "src", "dst")


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of the face pairs: `(face_id, slot, other)`."""
    both = F.array(
        F.struct(F.col("fa").alias("face_id"), F.col("slot_a").alias("slot"), F.col("fb").alias("other")),
        F.struct(F.col("fb").alias("face_id"), F.col("slot_b").alias("slot"), F.col("fa").alias("other")),
    )
    return pairs.select("scan_id", F.inline(both))


def boundary(faces: DataFrame | None = None, edge_table: DataFrame | None = None) -> DataFrame:
    """Half-edges of edges with one face, in the direction that face uses."""
    table = edges(faces) if edge_table is None else edge_table
    return table.filter(F.col("valence") == 1).select(
        "scan_id", F.col("fa").alias("face_id"), F.col("slot_a").alias("slot"), "src", "dst"
    )


def edge_counts(faces: DataFrame | None = None, edge_table: DataFrame | None = None) -> DataFrame:
    """Edges by valence and inconsistent manifold edges per scan."""
    v = F.col("valence")
    table = edges(faces) if edge_table is None else edge_table
    return table.groupBy("scan_id").agg(
        F.count("*").alias("edges"),
        F.count_if(v == 1).alias("boundary_edges"),
        F.count_if(v == 2).alias("manifold_edges"),
        F.count_if(v > 2).alias("non_manifold_edges"),
        F.count_if((v == 2) & ~F.col("consistent")).alias("inconsistent_edges"),
    )


def bounds(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["scan_id"]
    return vertices.groupBy(*keys).agg(
        *[f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    )


def diagonal() -> Column:
    """Length of the box diagonal of a `bounds` row."""
    return F.sqrt(sum((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in "xyz"))


def placed(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rows holding a point and the `bounds` of their scan with its place `near` along a Z-curve through the box."""
    extent = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"], F.lit(1e-12))
    last = (1 << PLACE_BITS) - 1
    df = df.withColumns({f"_{c}": F.floor((F.col(f"{prefix}{c}") - F.col(f"min_{c}")) / extent * last).bitwiseAND(F.lit(last)) for c in "xyz"})
    bits = [F.shiftleft(F.shiftright(f"_{c}", k).bitwiseAND(F.lit(1)), 3 * k + n) for k in range(PLACE_BITS) for n, c in enumerate("xyz")]
    return df.withColumn("near", sum(bits[1:], bits[0])).drop("_x", "_y", "_z")


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices some face refers to; ids stay as they are."""
    used = faces.select("scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return vertices.join(used, ["scan_id", "vertex_id"], "left_semi")


def signed_volume(tri: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed volume per scan about its vertex centroid.

    The sum is written out in monomials of the centre, so the centre joins one row
    per scan after the aggregation and the faces are read once.
    """
    a, b, c = face_vectors()
    area2 = b.cross(c) + c.cross(a) + a.cross(b)
    sums = tri.groupBy("scan_id").agg(
        F.sum(a.dot(b.cross(c))).alias("_v"), *[F.sum(k).alias(f"_s{n}") for n, k in zip("xyz", area2)]
    )
    centre = vertices.groupBy("scan_id").agg(*[F.avg(n).alias(f"_m{n}") for n in "xyz"])
    shift = vec("_m").dot(vec("_s"))
    return sums.join(centre, "scan_id").select(
        "scan_id", ((F.col("_v") - shift) / 6).alias("volume")
    )


def vertex_normals(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """Area-weighted vertex normals.

    Where the sum cancels, the cross product of the incident face with the highest id is
    used; vertices without a face get +Z.
    """
    k = face_cross()
    per_corner = tri.select(
        "scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "face_id", *k.named("k")
    )
    summed = cut(per_corner.groupBy("scan_id", "vertex_id").agg(
        *[F.sum(f"k{n}").alias(f"s{n}") for n in "xyz"],
        *[F.max_by(f"k{n}", "face_id").alias(f"b{n}") for n in "xyz"],
    ))
    largest = few(summed.groupBy("scan_id").agg(F.max(vec("s").norm()).alias("largest")))
    flat = vec("s").norm() <= 1e-12 * F.greatest("largest", F.lit(1e-300))
    chosen = V(*[
        F.coalesce(F.when(flat, F.col(f"b{n}")).otherwise(F.col(f"s{n}")), F.lit(1.0 if n == "z" else 0.0))
        for n in "xyz"
    ])
    length = F.greatest(chosen.norm(), F.lit(1e-300))
    return (
        vertices.join(summed.join(largest, "scan_id"), ["scan_id", "vertex_id"], "left")
        .select("scan_id", "vertex_id", "x", "y", "z", *(chosen / length).named("n"))
    )


def vertex_links(faces: DataFrame) -> DataFrame:
    """Distinct undirected mesh edges in both directions: `(vertex_id, other)`."""
    e = half_edges(faces).select("scan_id", "lo", "hi").filter("lo <> hi").distinct()
    both = F.array(
        F.struct(F.col("lo").alias("vertex_id"), F.col("hi").alias("other")),
        F.struct(F.col("hi").alias("vertex_id"), F.col("lo").alias("other")),
    )
    return e.select("scan_id", F.inline(both))
