"""Waves of region growth, label filling and boundary relaxation for whole fleets of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.primitives import signed_distance
from scanweave.functions.vec import V, vec
from scanweave.operators.graph import components
from scanweave.operators.quantiles import exact_percentiles
from scanweave.session import cut, held

KEY = ["scan_id", "face_id"]

# Fixed values.
CREASE_FACTOR = 3.0
CREASE_MIN_AREA = 0.5
ORPHAN_REACH = 3.0


def smooth_pairs(pairs: DataFrame, normals: DataFrame, max_angle_deg: float) -> DataFrame:
    """Adjacent faces whose normals differ by less than an angle."""
    side = lambda f, s: normals.select("scan_id", F.col("face_id").alias(f), *[F.col(f"n{c}").alias(f"n{c}{s}") for c in "xyz"])
    dot = vec("n", "_a").dot(vec("n", "_b"))
    return pairs.join(side("fa", "_a"), ["scan_id", "fa"]).join(side("fb", "_b"), ["scan_id", "fb"]).filter(
        dot > F.cos(F.radians(F.lit(max_angle_deg)))
    ).select(*pairs.columns)


def grow_components(seeds: DataFrame, faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Faces reachable from a seed across the given pairs, named by the smallest seed of the part.

    Unlimited growth is a component, so its rounds do not grow with the distance.
    """
    parts = components(faces.select(*KEY), pairs.select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b")))
    hit = seeds.select(*KEY).join(parts, KEY).groupBy("scan_id", "part").agg(F.min("face_id").alias("seed"))
    return parts.join(hit, ["scan_id", "part"]).select("scan_id", "seed", "face_id")


def grow_normal(seeds: DataFrame, pairs: DataFrame, normals: DataFrame, max_angle_deg: float) -> DataFrame:
    """`(scan_id, seed, face_id)`: connected faces whose normal lies within an angle of the seed's.

    Every seed has its own cone, so the frontier carries the seed; seeds grow side by side.
    """
    limit = F.cos(F.radians(F.lit(max_angle_deg)))
    seed_normal = cut(seeds.select(*KEY).join(normals, KEY).select("scan_id", F.col("face_id").alias("seed"), *[F.col(f"n{c}").alias(f"s{c}") for c in "xyz"]))
    other = normals.select("scan_id", F.col("face_id").alias("other"), *[f"n{c}" for c in "xyz"])
    both = pairs.select("scan_id", F.inline(F.array(
        F.struct(F.col("fa").alias("face_id"), F.col("fb").alias("other")), F.struct(F.col("fb").alias("face_id"), F.col("fa").alias("other")))))
    links = held(cut(both.join(other, ["scan_id", "other"])), *KEY)
    frontier = cut(seeds.select("scan_id", F.col("face_id").alias("seed"), "face_id"))
    seen, before, ring = frontier, None, 0
    while True:
        reached = frontier.join(links, KEY).join(seed_normal, ["scan_id", "seed"]).filter(vec("n").dot(vec("s")) > limit)
        # Links go both ways, so a neighbour of a ring that is not new lies in this ring or the one before.
        known = frontier if before is None else frontier.unionByName(before)
        found = cut(reached.select("scan_id", "seed", F.col("other").alias("face_id")).distinct().join(known, ["scan_id", "seed", "face_id"], "left_anti"))
        if found.isEmpty():
            links.unpersist()
            return seen
        before, frontier, ring = frontier, found, ring + 1
        seen = seen.unionByName(found)
        if ring % 64 == 0:
            seen = cut(seen)


def fill_wave(labels: DataFrame, links: DataFrame, normals: DataFrame) -> DataFrame:
    """Unassigned faces take the label of the neighbour with the most similar normal."""
    own = labels.filter("label = 0").select(*KEY)
    near = links.join(own, KEY, "left_semi").join(
        labels.filter("label > 0").select("scan_id", F.col("face_id").alias("other"), "label"), ["scan_id", "other"])
    side = lambda f, s: normals.select("scan_id", F.col("face_id").alias(f), *[F.col(f"n{c}").alias(f"n{c}{s}") for c in "xyz"])
    scored = near.join(side("face_id", "_a"), KEY).join(side("other", "_b"), ["scan_id", "other"])
    dot = vec("n", "_a").dot(vec("n", "_b"))
    best = scored.groupBy(*KEY).agg(F.max_by("label", F.struct(dot, -F.col("label"))).alias("_new"))
    return labels.join(best, KEY, "left").select(*KEY, F.coalesce("_new", "label").alias("label"))


def fill_unassigned(labels: DataFrame, links: DataFrame, normals: DataFrame, centroids: DataFrame) -> DataFrame:
    """Waves of `fill_wave` until nothing changes; islands join the nearest region within reach."""
    from scanweave.operators.spatial import nearest

    labels = cut(labels)
    left = labels.filter("label = 0").count()
    while left > 0:
        labels = cut(fill_wave(labels, links, normals))
        now = labels.filter("label = 0").count()
        if now == left:
            break
        left = now
    if left == 0 or labels.filter("label > 0").isEmpty():
        return labels
    at = labels.join(centroids.select(*KEY, F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z")), KEY)
    lost = at.filter("label = 0").withColumnRenamed("face_id", "q_id")
    known = at.filter("label > 0").withColumnRenamed("face_id", "t_id")
    hit = nearest(lost, known).filter(F.col("dist") < ORPHAN_REACH)
    taken = hit.join(labels.select("scan_id", F.col("face_id").alias("t_id"), F.col("label").alias("_new")), ["scan_id", "t_id"])
    return labels.join(taken.select("scan_id", F.col("q_id").alias("face_id"), "_new"), KEY, "left").select(
        *KEY, F.coalesce("_new", "label").alias("label"))


def relax_wave(labels: DataFrame, links: DataFrame, centroids: DataFrame, primitives: DataFrame) -> DataFrame:
    """Every labelled face takes the label, its own or a neighbour's, whose primitive is closest."""
    other = labels.filter("label > 0").select("scan_id", F.col("face_id").alias("other"), "label")
    near = links.join(other, ["scan_id", "other"]).select(*KEY, "label", F.lit(1).alias("_far"))
    own = labels.filter("label > 0").select(*KEY, "label", F.lit(0).alias("_far"))
    options = own.unionByName(near).groupBy(*KEY, "label").agg(F.min("_far").alias("_far"))
    # Faces surrounded by their own label have one option and keep it.
    p = V(F.col("gx"), F.col("gy"), F.col("gz"))
    scored = options.join(centroids, KEY).join(primitives, ["scan_id", "label"]).withColumn("_d", F.abs(signed_distance(p)))
    best = scored.groupBy(*KEY).agg(F.min_by("label", F.struct("_d", "_far", "label")).alias("_new"))
    return labels.join(best, KEY, "left").select(
        *KEY, F.when(F.col("label") > 0, F.coalesce("_new", "label")).otherwise(F.col("label")).alias("label"))


def relax_boundaries(labels: DataFrame, links: DataFrame, centroids: DataFrame, primitives: DataFrame) -> DataFrame:
    """Waves of `relax_wave` until no face changes; every change brings a face closer, so they end."""
    labels = cut(labels)
    while True:
        moved = cut(relax_wave(labels, links, centroids, primitives))
        changed = moved.join(labels.withColumnRenamed("label", "_old"), KEY).filter("label <> _old").limit(1)
        labels = moved
        if changed.isEmpty():
            break
    return labels


def crease_zone(faces: DataFrame, residual: DataFrame, area: DataFrame) -> DataFrame:
    """Faces with a vertex whose ring-mean residual exceeds three medians; fragments below
    half a square unit are dropped."""
    from scanweave.operators.mesh import face_pairs, vertex_links

    ring = vertex_links(faces).select("scan_id", "vertex_id", "other").unionByName(
        residual.select("scan_id", "vertex_id", F.col("vertex_id").alias("other")))
    mean = ring.join(residual.select("scan_id", F.col("vertex_id").alias("other"), "residual"), ["scan_id", "other"]).groupBy(
        "scan_id", "vertex_id").agg(F.avg("residual").alias("_mean"))
    median = exact_percentiles(residual, ["scan_id"], "residual", {"_median": 0.5})
    hot = mean.join(median, "scan_id").filter(F.col("_mean") / F.greatest("_median", F.lit(1e-12)) > CREASE_FACTOR).select("scan_id", "vertex_id")
    corner = faces.filter("NOT synthetic").select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    zone = cut(corner.join(hot, ["scan_id", "vertex_id"], "left_semi").select(*KEY).distinct())
    place = [c for c in ("near",) if c in faces.columns]
    pairs = face_pairs(faces, place)
    for side in ("fa", "fb"):
        pairs = pairs.join(zone.withColumnRenamed("face_id", side), ["scan_id", side], "left_semi")
    parts = components(zone, pairs.select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b"), *place))
    large = parts.join(area, KEY).groupBy("scan_id", "part").agg(F.sum("area").alias("_a")).filter(F.col("_a") >= CREASE_MIN_AREA)
    return parts.join(large, ["scan_id", "part"], "left_semi").select(*KEY)
