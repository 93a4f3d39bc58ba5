"""Sections of meshes: segments, chains, support points, rotational profiles, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec
from scanweave.operators.graph import components
from scanweave.operators.loops import ordered
from scanweave.session import cut

# Fixed values.
BAND_HALF_WIDTH = 0.4
BAND_MAX_TILT = 0.1
MIN_POINTS = 8
# Links that follow each other are met together by their place along a direction no plane is likely to be square to.
SWEEP = (0.5403, 0.6819, 0.4931)


def _cut_edges(df: DataFrame, level: Column) -> DataFrame:
    """Where a triangle crosses a level of its corner heights `ha, hb, hc`.

    The mesh edge the surface goes down through starts the segment, the one it comes up through
    ends it; on a consistently wound mesh the end of a segment is the start of the next.
    """
    above = {c: F.col(f"h{c}") > level for c in "abc"}
    crossed = sum(above[c].cast("int") for c in "abc").isin(1, 2)
    corner = F.array(*[F.struct(F.col(f"v{n}").alias("v"), F.col(f"h{c}").alias("h"), *[F.col(f"{c}{k}").alias(k) for k in "xyz"])
                       for n, c in enumerate("abc")])
    down = F.when(above["a"] & ~above["b"], 0).when(above["b"] & ~above["c"], 1).otherwise(2)
    up = F.when(~above["a"] & above["b"], 0).when(~above["b"] & above["c"], 1).otherwise(2)
    # The edge is chosen first and the point computed once: a formula per edge outgrew what the JVM compiles.
    df = df.filter(crossed).select("*", level.alias("_level"), corner.alias("_corner"), down.alias("_down"), up.alias("_up"))
    for name, side in (("s", "_down"), ("e", "_up")):
        ends = [F.col("_corner")[F.col(side)], F.col("_corner")[(F.col(side) + 1) % 3]]
        df = df.withColumns({f"_{name}p": ends[0], f"_{name}q": ends[1]})

    def crossing(p: Column, q: Column) -> Column:
        # Evaluated from the lower vertex id, so both faces of an edge get the same point.
        i, j = p["v"], q["v"]
        first = i < j
        lo, hi = ({k: F.when(first, x[k]).otherwise(y[k]) for k in "hxyz"} for x, y in ((p, q), (q, p)))
        t = (F.col("_level") - lo["h"]) / F.when(hi["h"] == lo["h"], 1.0).otherwise(hi["h"] - lo["h"])
        return F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), *[(lo[k] + (hi[k] - lo[k]) * t).alias(k) for k in "xyz"])

    return df.select("*", *[crossing(F.col(f"_{n}p"), F.col(f"_{n}q")).alias(f"_{n}") for n in "se"])


def _segments(df: DataFrame) -> DataFrame:
    return df.select(
        "scan_id", "section_id", "face_id",
        *[F.col(f"_{side}.{name}").alias(f"{side}{name}") for side in ("s", "e") for name in ("lo", "hi", "x", "y", "z")])


def stack_segments(tri: DataFrame, axis: V, start: float, step: float, count: int) -> DataFrame:
    """Segments of a stack of parallel planes; each face lists the planes it crosses.

    `tri` holds `v0, v1, v2, ax … cz`. Plane k lies at `start + k * step` along the axis.
    """
    df = tri.withColumns({f"h{c}": vec(c).dot(axis) for c in "abc"})
    low, high = F.least("ha", "hb", "hc"), F.greatest("ha", "hb", "hc")
    first = F.greatest(F.ceil((low - start) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((high - start) / step), F.lit(count - 1)).cast("int")
    df = df.withColumn("section_id", F.explode(F.when(last >= first, F.sequence(first, last))))
    return _segments(_cut_edges(df, F.lit(start) + F.col("section_id") * step))


def plane_segments(tri: DataFrame, planes: DataFrame) -> DataFrame:
    """Segments of single planes `(scan_id, section_id, o*, n*)`; a scan has a handful of them."""
    df = tri.join(planes, "scan_id")
    df = df.withColumns({f"h{c}": (vec(c) - vec("o")).dot(vec("n")) for c in "abc"})
    return _segments(_cut_edges(df, F.lit(0.0)))


def chain_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polylines of section segments: `chains(scan_id, section_id, chain_id, closed, points)` and
    ordered points `(…, chain_id, pos, x, y, z)`.

    A segment is a node; its successor starts on the mesh edge it ends on. Chain id is its
    smallest face.
    """
    keys = ["scan_id", "section_id"]
    seg = cut(segments)
    # An edge with more than one start is not manifold: the smallest face goes on, after the smallest that ends there.
    side = lambda n, a, b: F.struct(
        F.col(f"{n}lo").alias("lo"), F.col(f"{n}hi").alias("hi"), a.alias("a"), b.alias("b"),
        sum(F.col(f"{n}{c}") * w for c, w in zip("xyz", SWEEP)).alias("near"))
    none = F.lit(None).cast("long")
    met = seg.select(*keys, F.inline(F.array(side("e", F.col("face_id"), none), side("s", none, F.col("face_id")))))
    after = met.filter("lo IS NOT NULL").groupBy(*keys, "lo", "hi").agg(*[F.min(c).alias(c) for c in ("a", "b", "near")])
    order = ordered(after.filter("a <> b").select(*keys, "a", "b", "near"), keys).withColumnRenamed("a", "face_id")
    at = cut(seg.join(order, [*keys, "face_id"], "left").select(
        *keys, F.coalesce("part", "face_id").alias("chain_id"), F.coalesce("closed", F.lit(False)).alias("closed"),
        F.coalesce("n", F.lit(1)).alias("_n"), F.coalesce("pos", F.lit(0)).alias("pos"), *[f"{e}{c}" for e in "se" for c in "xyz"]))
    base = [*keys, "chain_id", "closed"]
    begin = at.select(*base, "pos", *[F.col(f"s{c}").alias(c) for c in "xyz"])
    final = at.filter(~F.col("closed") & (F.col("pos") == F.col("_n") - 1)).select(
        *base, F.col("_n").alias("pos"), *[F.col(f"e{c}").alias(c) for c in "xyz"])
    chains = at.filter("pos = 0").select(*base, F.when(F.col("closed"), F.col("_n")).otherwise(F.col("_n") + 1).alias("points"))
    return chains, begin.unionByName(final)


def support_points(vertices: DataFrame, origin: V, normal: V) -> DataFrame:
    """Scan vertices near a cut plane on walls perpendicular to it (`n*` are vertex normals)."""
    near = F.abs((vec() - origin).dot(normal)) <= BAND_HALF_WIDTH
    return vertices.filter(near & (F.abs(vec("n").dot(normal)) <= BAND_MAX_TILT))


def every_nth(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """Every n-th row of a scan so that about `cap` remain."""
    from scanweave.operators.ranking import dense_ids

    counts = rows.groupBy("scan_id").agg(F.greatest(F.floor(F.count("*") / cap), F.lit(1)).alias("_stride"))
    return dense_ids(rows, key, "_row").join(counts, "scan_id").filter("_row % _stride = 0").drop("_row", "_stride")


def half_plane_runs(points: DataFrame) -> DataFrame:
    """Stretches of section points with v >= 0, ended where the polyline crosses the axis.

    `points(scan_id, chain_id, closed, pos, u, v)`. Runs are components of consecutive kept
    points, so closed chains need no rotation; crossing points carry half positions.
    """
    from scanweave.operators.polylines import CHAIN

    n = points.groupBy(*CHAIN).agg(F.count("*").alias("_n"))
    p = cut(points.join(n, CHAIN))
    nxt = F.when(F.col("closed"), (F.col("pos") + 1) % F.col("_n")).otherwise(F.col("pos") + 1)
    follow = p.select(*CHAIN, F.col("pos").alias("_next"), F.col("u").alias("u1"), F.col("v").alias("v1"))
    step = cut(p.withColumn("_next", nxt).join(follow, [*CHAIN, "_next"]))
    key = F.concat_ws("#", "scan_id", "chain_id").alias("scan_id")
    links = step.filter("v >= 0 AND v1 >= 0").select(key, F.col("pos").cast("long").alias("a"), F.col("_next").cast("long").alias("b"))
    kept = p.filter("v >= 0").withColumn("_key", F.concat_ws("#", "scan_id", "chain_id"))
    parts = components(kept.select(F.col("_key").alias("scan_id"), F.col("pos").cast("long").alias("pos")), links, node="pos").withColumnRenamed("scan_id", "_key")
    runs = cut(kept.join(parts, ["_key", "pos"]).select(*CHAIN, "pos", F.col("part").alias("run"), "u", "v"))
    t = F.col("v") / (F.col("v") - F.col("v1"))
    cross = step.filter("(v >= 0) <> (v1 >= 0)").select(
        *CHAIN, F.when(F.col("v") >= 0, F.col("pos")).otherwise(F.col("_next")).alias("_own"), F.when(F.col("v") >= 0, 0.5).otherwise(-0.5).alias("_half"),
        (F.col("u") + t * (F.col("u1") - F.col("u"))).alias("u"), F.lit(0.0).alias("v"))
    ends = cross.join(runs.select(*CHAIN, F.col("pos").alias("_own"), "run"), [*CHAIN, "_own"]).select(
        *CHAIN, (F.col("_own") + F.col("_half")).alias("pos"), "run", "u", "v")
    return runs.withColumn("pos", F.col("pos").cast("double")).unionByName(ends)


def section_areas(points: DataFrame, axis: V) -> DataFrame:
    """Signed area of closed chains about an axis and their extent, per section."""
    nxt = points.filter("closed").select("scan_id", "section_id", "chain_id", (F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    first = points.filter("closed AND pos = 0").select("scan_id", "section_id", "chain_id", *[F.col(c).alias(f"f{c}") for c in "xyz"])
    keys = ["scan_id", "section_id", "chain_id"]
    p = points.filter("closed").join(nxt, [*keys, "pos"], "left").join(first, keys)
    following = V(*[F.coalesce(f"n{c}", f"f{c}") for c in "xyz"])
    # The first point is the local origin, so the sum does not lose digits far from zero.
    own, other = vec() - vec("f"), following - vec("f")
    return p.groupBy(*keys).agg((F.sum(own.cross(other).dot(axis)) / 2).alias("area"))
