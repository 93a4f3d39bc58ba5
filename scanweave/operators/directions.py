"""Directions and planes of scans: bins, cones, levels, moments, robust planes, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanweave.functions.vec import V, stage, vec
from scanweave.operators.quantiles import exact_percentiles, robust_sigma
from scanweave.session import cut

# Fixed values.
DIRECTIONS = 2_000
CONE_DEG = 15.0
TUKEY = 4.685
MEMBER_DEG = 10.0
MIN_AREA_SHARE = 0.02
CELL = 0.1
PLANES = "scan_id string, plane_id int, area double, faces long, rms double, px double, py double, pz double, qx double, qy double, qz double"


def fibonacci_directions(spark: SparkSession, count: int = DIRECTIONS) -> DataFrame:
    """Evenly spread unit directions `(bin, dx, dy, dz)`."""
    k = F.col("id") + 0.5
    polar, azimuth = F.acos(1 - 2 * k / count), pi * (1 + 5**0.5) * k
    return spark.range(count).select(
        F.col("id").cast("int").alias("bin"), (F.cos(azimuth) * F.sin(polar)).alias("dx"),
        (F.sin(azimuth) * F.sin(polar)).alias("dy"), F.cos(polar).alias("dz"))


def direction_bins(rows: DataFrame, n: V) -> DataFrame:
    """Nearest direction of unit normals.

    A cell of the unit cube lists the directions around it, so a row meets one cell and picks
    its direction without a shuffle. The table is fixed: 2,000 directions, 27 cells each.
    """
    spread = fibonacci_directions(rows.sparkSession)
    for c in "xyz":
        spread = spread.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"d{c}") / CELL) - 1, F.floor(F.col(f"d{c}") / CELL) + 1)))
    cells = spread.groupBy("_cx", "_cy", "_cz").agg(F.collect_list(F.struct("bin", "dx", "dy", "dz")).alias("_near"))
    placed = rows.withColumns({f"_c{c}": F.floor(x / CELL) for c, x in zip("xyz", n)})
    score = F.transform("_near", lambda d: F.struct(
        (d["dx"] * n.x + d["dy"] * n.y + d["dz"] * n.z).alias("dot"), (-d["bin"]).alias("back")))
    # Bounded by the number of directions, so the table goes to every task.
    return placed.join(F.broadcast(cells), ["_cx", "_cy", "_cz"], "left").select(
        *rows.columns, (-F.array_max(score)["back"]).alias("bin"))


def cone_areas(bins: DataFrame, cone_deg: float = CONE_DEG) -> DataFrame:
    """Area within a cone around every direction of `(scan_id, bin, area)`, one row per bin."""
    d = fibonacci_directions(bins.sparkSession)
    own = bins.groupBy("scan_id", "bin").agg(F.sum("area").alias("area")).join(F.broadcast(d), "bin")
    reach = 2 * F.sin(F.radians(F.lit(cone_deg)) / 2)
    h = 0.3
    centre = d.select(F.col("bin").alias("centre"), *[F.col(f"d{c}").alias(f"e{c}") for c in "xyz"])
    for c in "xyz":
        centre = centre.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"e{c}") / h) - 1, F.floor(F.col(f"e{c}") / h) + 1)))
    placed = own.withColumns({f"_c{c}": F.floor(F.col(f"d{c}") / h) for c in "xyz"})
    gap = F.sqrt(sum((F.col(f"d{c}") - F.col(f"e{c}")) ** 2 for c in "xyz"))
    met = placed.join(F.broadcast(centre), ["_cx", "_cy", "_cz"]).filter(gap <= reach)
    return met.groupBy("scan_id", "centre").agg(F.sum("area").alias("cone_area"))


def dominant_direction(faces: DataFrame) -> DataFrame:
    """Area-weighted mean normal of the cone that covers most area, per scan."""
    bins = cut(direction_bins(faces.select("scan_id", "face_id", "area", "nx", "ny", "nz"), vec("n")))
    best = cone_areas(bins).groupBy("scan_id").agg(F.max_by("centre", F.struct(F.round("cone_area", 9), -F.col("centre"))).alias("bin"))
    axis = best.join(fibonacci_directions(faces.sparkSession), "bin").select("scan_id", "bin", "dx", "dy", "dz")
    inside = vec("n").dot(vec("d")) > F.cos(F.radians(F.lit(CONE_DEG)))
    mean = bins.drop("bin").join(axis, "scan_id").filter(inside).groupBy("scan_id", "bin").agg(
        *[F.sum(F.col("area") * F.col(f"n{c}")).alias(f"m{c}") for c in "xyz"], F.sum("area").alias("area"))
    mean = stage(mean, u=vec("m").unit())
    return mean.select("scan_id", "bin", "area", *[F.col(f"u{c}").alias(f"d{c}") for c in "xyz"])


def level_histogram(rows: DataFrame, offset: Column, weight: Column, width: float, smoothed: bool = False) -> DataFrame:
    """Weight per offset bin from the lowest offset of the scan, optionally summed over 3 bins."""
    r = rows.select("scan_id", offset.alias("_o"), weight.alias("_w"))
    low = r.groupBy("scan_id").agg(F.min("_o").alias("low"))
    bins = r.join(low, "scan_id").groupBy("scan_id", "low", F.floor((F.col("_o") - F.col("low")) / width).alias("bin")).agg(F.sum("_w").alias("weight"))
    if smoothed:
        near = F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))
        bins = bins.withColumn("_to", near).groupBy("scan_id", "low", F.col("_to").alias("bin")).agg(F.sum("weight").alias("weight"))
    return bins


def level_peak(histogram: DataFrame, width: float) -> DataFrame:
    """Centre of the heaviest bin (the lowest of equals) per scan."""
    best = histogram.groupBy("scan_id", "low").agg(F.max_by("bin", F.struct(F.round("weight", 9), -F.col("bin"))).alias("bin"))
    return best.select("scan_id", "bin", (F.col("low") + (F.col("bin") + 0.5) * width).alias("level"))


def area_moments(tri: DataFrame) -> DataFrame:
    """Exact area, centroid and second moment of the surface of every scan."""
    a, b, c = vec("a"), vec("b"), vec("c")
    area = (b - a).cross(c - a).norm() * 0.5
    s = a + b + c
    t = tri.select("scan_id", *a.named("a"), *b.named("b"), *c.named("c"), *s.named("s"), area.alias("w"))
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    raw = {f"{p}{q}": sum(F.col(f"{v}{p}") * F.col(f"{v}{q}") for v in "abcs") for p, q in pairs}
    m = t.groupBy("scan_id").agg(
        F.sum("w").alias("area"), *[F.sum(F.col("w") * F.col(f"s{p}") / 3).alias(f"f{p}") for p in "xyz"],
        *[F.sum(F.col("w") * e / 12).alias(f"m{k}") for k, e in raw.items()])
    m = m.select("scan_id", "area", *[(F.col(f"f{p}") / F.col("area")).alias(f"c{p}") for p in "xyz"], *[(F.col(f"m{k}") / F.col("area")).alias(f"m{k}") for k in raw])
    # Moving the moment to the centroid: the raw second moment loses the square of the mean.
    return m.select("scan_id", "area", "cx", "cy", "cz", *[(F.col(f"m{p}{q}") - F.col(f"c{p}") * F.col(f"c{q}")).alias(f"m{p}{q}") for p, q in pairs])


def _principal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        m = np.empty((len(b), 3, 3))
        for i, p in enumerate("xyz"):
            for j, q in enumerate("xyz"):
                m[:, i, j] = b[f"m{min(p, q)}{max(p, q)}"]
        vectors = np.linalg.eigh(m)[1]
        out = b[["scan_id", "cx", "cy", "cz"]].rename(columns={f"c{c}": f"q{c}" for c in "xyz"})
        for k, name in enumerate("uvw"):
            out[[f"{name}{c}" for c in "xyz"]] = vectors[:, :, 2 - k]
        yield out


def principal_frame(tri: DataFrame, moments: DataFrame) -> DataFrame:
    """Principal axes per scan, largest extent first, signed by the third moment of the area."""
    axes = cut(moments.mapInPandas(_principal, "scan_id string, " + ", ".join(f"{p}{c} double" for p in "quvw" for c in "xyz")))
    a, b, c = vec("a"), vec("b"), vec("c")
    t = stage(tri.join(axes, "scan_id").withColumn("_w", (b - a).cross(c - a).norm() * 0.5), _g=(a + b + c) / 3.0 - vec("q"))
    skew = t.groupBy("scan_id").agg(*[F.sum(F.col("_w") * F.pow(vec("_g").dot(vec(p)), F.lit(3.0))).alias(f"k{p}") for p in "uv"])
    signed = axes.join(skew, "scan_id")
    u, v = (vec(p) * F.when(F.col(f"k{p}") >= 0, 1.0).otherwise(-1.0) for p in "uv")
    return signed.select("scan_id", "qx", "qy", "qz", *u.named("u"), *v.named("v"), *u.cross(v).named("w"))


def _smallest_axis(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    for b in batches:
        m = np.empty((len(b), 3, 3))
        for i, p in enumerate("xyz"):
            for j, q in enumerate("xyz"):
                m[:, i, j] = b[f"v{min(p, q)}{max(p, q)}"]
        out = b[[*keys, "ox", "oy", "oz"]].copy()
        out[["nx", "ny", "nz"]] = np.linalg.eigh(m)[1][:, :, 0]
        yield out


def _weighted_plane(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Plane of weighted points `(…, x, y, z, w)` by covariance, centred before squaring."""
    w = F.col("w")
    mean = rows.groupBy(*keys).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"o{c}") for c in "xyz"])
    d = rows.join(mean, keys)
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    sums = d.groupBy(*keys, "ox", "oy", "oz").agg(
        *[F.sum(w * (F.col(p) - F.col(f"o{p}")) * (F.col(q) - F.col(f"o{q}"))).alias(f"v{p}{q}") for p, q in pairs])
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{p}{c} double" for p in "on" for c in "xyz"])
    return cut(sums.mapInPandas(lambda it: _smallest_axis(it, keys), schema))


def robust_planes(points: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """Planes by iteratively reweighted least squares (Tukey), all groups side by side."""
    points = cut(points.select(*keys, "x", "y", "z"))
    weighted = points.withColumn("w", F.lit(1.0))
    for _ in range(rounds):
        plane = _weighted_plane(weighted, keys)
        residual = points.join(plane, keys).withColumn("r", (vec() - vec("o")).dot(vec("n")))
        scale = cut(exact_percentiles(residual, keys, F.abs("r"), {"_mad": 0.5}).select(*keys, F.greatest(1.4826 * F.col("_mad"), F.lit(1e-4)).alias("scale")))
        u = F.col("r") / (TUKEY * F.col("scale"))
        weighted = residual.join(scale, keys).withColumn("w", F.when(F.abs(u) < 1, (1 - u * u) ** 2).otherwise(0.0)).select(*keys, "x", "y", "z", "r", "w")
    rms = weighted.filter("w > 0").groupBy(*keys).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))
    return plane.join(rms, keys)


def _facing_plane(members: DataFrame) -> DataFrame:
    """Plane of the faces `(scan_id, area, g*, n*)` of each scan, its normal on the side of the faces' normals."""
    rows = members.select("scan_id", *[F.col(f"g{c}").alias(c) for c in "xyz"], F.lit(1.0).alias("w"))
    plane = _weighted_plane(rows, ["scan_id"])
    side = members.groupBy("scan_id").agg(*[F.sum(F.col("area") * F.col(f"n{c}")).alias(f"s{c}") for c in "xyz"])
    turn = F.when(vec("n").dot(vec("s")) < 0, -1.0).otherwise(1.0)
    return cut(plane.join(side, "scan_id").select("scan_id", *vec("o").named("p"), *(vec("n") * turn).named("q")))


def _near_plane(faces: DataFrame, plane: DataFrame, width: float) -> DataFrame:
    inside = (F.abs((vec("g") - vec("p")).dot(vec("q"))) <= width) & (vec("n").dot(vec("q")) > F.cos(F.radians(F.lit(MEMBER_DEG))))
    return faces.join(plane, "scan_id").filter(inside).select(*faces.columns)


def detect_planes(faces: DataFrame, band: float) -> DataFrame:
    """Large planes of every scan, one per round: dominant direction, level band, refits on all faces near it.

    `faces(scan_id, face_id, area, g*, n*)`; `p*` is a point of the plane, `q*` its outward normal. Faces
    of a found plane leave the search; a scan stops when its best direction covers less than two percent
    of its area. The first refits use a wider band, so that a tilted start does not keep one end of a face.
    A level whose residuals spread evenly over the band is a strip of a curved surface and no plane, and
    a plane that a refit turned into a copy of a larger one is dropped. Every round takes at least the
    level of the best direction, so the search ends; without planes the result is empty.
    """
    total = cut(faces.groupBy("scan_id").agg(F.sum("area").alias("_total")))
    every = cut(faces.select("scan_id", "face_id", "area", *[f"{p}{c}" for p in "gn" for c in "xyz"]))
    rest = every
    found = faces.sparkSession.createDataFrame([], PLANES)
    for number in count():
        direction = cut(dominant_direction(rest).join(total, "scan_id").filter(F.col("area") >= MIN_AREA_SHARE * F.col("_total")).select("scan_id", "dx", "dy", "dz", "_total"))
        if direction.isEmpty():
            return _distinct_planes(found, band)
        facing = rest.join(direction, "scan_id").withColumn("_o", vec("g").dot(vec("d"))).filter(vec("n").dot(vec("d")) > F.cos(F.radians(F.lit(CONE_DEG))))
        level = level_peak(level_histogram(facing, F.col("_o"), F.col("area"), band), band).select("scan_id", "level")
        seed = cut(facing.join(level, "scan_id").filter(F.abs(F.col("_o") - F.col("level")) <= 1.5 * band).select(*every.columns))
        members = seed
        for width in (3.0, 2.0, 1.0, 1.0):
            plane = _facing_plane(members)
            members = cut(_near_plane(every, plane, width * band))
        own = members.join(plane, "scan_id").select("scan_id", "area", (vec("g") - vec("p")).dot(vec("q")).alias("r"))
        spread = robust_sigma(own, ["scan_id"], "r").filter(F.col("sigma") <= band / 3).select("scan_id")
        size = own.groupBy("scan_id").agg(F.sum("area").alias("area"), F.count("*").alias("faces"), F.sqrt(F.avg(F.col("r") ** 2)).alias("rms"))
        row = plane.join(size, "scan_id").join(spread, "scan_id", "left_semi").join(total, "scan_id").filter(
            (F.col("faces") >= 3) & (F.col("area") >= MIN_AREA_SHARE * F.col("_total"))).select(
            "scan_id", F.lit(number).alias("plane_id"), "area", "faces", "rms", *[f"p{c}" for c in "xyz"], *[f"q{c}" for c in "xyz"])
        found = cut(found.unionByName(row))
        taken = members.unionByName(seed).select("scan_id", "face_id").distinct()
        rest = cut(rest.join(taken, ["scan_id", "face_id"], "left_anti").join(direction.select("scan_id"), "scan_id", "left_semi"))


def _distinct_planes(planes: DataFrame, band: float) -> DataFrame:
    """Planes but those that lie on a larger one of the same direction; a scan has tens of planes."""
    other = planes.select("scan_id", *[F.col(c).alias(f"{c}_b") for c in ("plane_id", "area", *[f"{p}{c}" for p in "pq" for c in "xyz"])])
    larger = (F.col("area_b") > F.col("area")) | ((F.col("area_b") == F.col("area")) & (F.col("plane_id_b") < F.col("plane_id")))
    same = (vec("q").dot(vec("q", "_b")) > F.cos(F.radians(F.lit(CONE_DEG)))) & (F.abs((vec("p") - vec("p", "_b")).dot(vec("q", "_b"))) <= band)
    copies = planes.join(other, "scan_id").filter(larger & same).select("scan_id", "plane_id").distinct()
    return planes.join(copies, ["scan_id", "plane_id"], "left_anti")


def cluster_directions(rows: DataFrame, tolerance_deg: float) -> DataFrame:
    """Greedy sign-free clusters of weighted directions per scan, global axes locked.

    `rows(scan_id, item_id, nx, ny, nz, weight)` holds feature directions, tens per scan.
    """
    limit = float(np.cos(np.radians(tolerance_deg)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "item_id"], ascending=[False, True], ignore_index=True)
        d = frame[["nx", "ny", "nz"]].to_numpy()
        d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
        w = frame["weight"].to_numpy()
        cluster = np.full(len(d), -1)
        heads: list[np.ndarray] = []
        while (cluster < 0).any():
            first = int(np.argmax(cluster < 0))
            group = (cluster < 0) & (np.abs(d @ d[first]) > limit)
            group[first] = True
            head = np.linalg.eigh(d[group].T @ (d[group] * w[group, None]))[1][:, -1]
            for axis in np.eye(3):
                if abs(head @ axis) > limit:
                    head = axis * np.sign(head @ axis)
                    break
            cluster[group] = len(heads)
            heads.append(head)
        snapped = np.array(heads)[cluster]
        snapped = snapped * np.sign(np.einsum("ij,ij->i", snapped, d))[:, None]
        out = frame[["scan_id", "item_id"]].copy()
        out["cluster"] = cluster
        out[["nx", "ny", "nz"]] = snapped
        return out

    return rows.groupBy("scan_id").applyInPandas(run, "scan_id string, item_id long, cluster int, nx double, ny double, nz double")


def feature_groups(features: DataFrame, size: list[str]) -> DataFrame:
    """Number equal features of a scan by plane, kind, top, rounded sizes and height, in order of
    first appearance; free profiles stay on their own. A scan has tens of features."""
    own = F.when(F.col("shape") == "profile", F.col("feature_id"))
    key = F.struct("plane_id", "kind", "top", "shape", own.alias("_own"), *[F.round(c, 3).alias(c) for c in [*size, "height"]])
    first = F.min("feature_id").over(W.partitionBy("scan_id", key))
    rows = features.withColumn("_first", first)
    return rows.withColumn("group_id", F.dense_rank().over(W.partitionBy("scan_id").orderBy("_first")) - 1).drop("_first")


def value_runs(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Runs of sorted values that span less than the tolerance, each with its mean.

    A run starts at its smallest value and never chains beyond the tolerance from it, so runs
    follow one another; a group holds the heights of one plane's features.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([value, "item_id"], ignore_index=True)
        values = frame[value].to_numpy()
        number, start, runs = -1, -np.inf, np.empty(len(values), dtype=int)
        for k, v in enumerate(values):
            if v - start >= tolerance:
                number, start = number + 1, v
            runs[k] = number
        frame["run"] = runs
        frame["mean"] = frame.groupby("run")[value].transform("mean")
        return frame[[*keys, "item_id", "run", "mean"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in [*keys, "item_id"]] + ["run int", "mean double"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def edge_radii(rows: DataFrame, keys: list[str], wanted: Column, noise: float) -> DataFrame:
    """Radius of rounded edges over their cross-sections `(…, radius, rms, points)`.

    Median, uncertainty, 10th and 90th percentile; edges measured by too few of the `wanted`
    sections are dropped.
    """
    p = exact_percentiles(rows, keys, "radius", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sqrt(F.sum(F.col("rms") ** 2 * F.col("points")) / F.greatest(F.sum("points"), F.lit(1))).alias("rms"),
        F.max(wanted).alias("_wanted"))
    spread = rows.join(p.select(*keys, "median"), keys).withColumn("_gap", F.abs(F.col("radius") - F.col("median")))
    mad = exact_percentiles(spread, keys, "_gap", {"_mad": 0.5})
    enough = F.col("samples") >= F.greatest(F.lit(3), F.floor(F.col("_wanted") / 4))
    error = F.greatest(1.2533 * 1.4826 * F.col("_mad") / F.sqrt("samples"), 0.02 * F.col("median"), F.lit(noise))
    return base.join(p, keys).join(mad, keys).filter(enough).select(
        *keys, F.when(F.col("median") >= 0.05, F.col("median")).otherwise(0.0).alias("radius"), error.alias("uncertainty"), "rms", "samples", "p10", "p90")


def same_features(features: DataFrame, cell: float, lateral: float, share: float) -> DataFrame:
    """Losers among features seen from two planes: same axis line and size, the smaller area
    (then the larger id) gives way.

    `features(scan_id, feature_id, plane_id, x, y, z, n*, size, area)`; candidates meet in the
    cells around their centre, so distant features are never compared.
    """
    from scanweave.operators.spatial import CELL as CELLS, with_block, with_cell

    own = with_cell(features, cell)
    side = own.select("scan_id", *CELLS, *[F.col(c).alias(f"{c}_b") for c in ("feature_id", "plane_id", "x", "y", "z", "nx", "ny", "nz", "size", "area")])
    met = with_block(own).join(side, ["scan_id", *CELLS]).filter("feature_id <> feature_id_b AND plane_id <> plane_id_b")
    gap = vec("", "_b") - vec()
    off = (gap - vec("n") * gap.dot(vec("n"))).norm()
    same = (F.abs(vec("n").dot(vec("n", "_b"))) > 0.996) & (off <= lateral) & (F.abs(F.col("size") - F.col("size_b")) <= share * F.greatest("size", "size_b"))
    worse = (F.col("area") < F.col("area_b")) | ((F.col("area") == F.col("area_b")) & (F.col("feature_id") > F.col("feature_id_b")))
    return met.filter(same & worse).select("scan_id", "feature_id").distinct()
