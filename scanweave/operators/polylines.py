"""Ordered polylines `(scan_id, chain_id, pos, u, v)`: windows, arc length, noise, moments.

Windows never span a whole chain. A chain is cut into blocks of positions; each block also
receives the few rows of its neighbours that a frame can reach (for closed chains the rows
beyond the seam as well), so a chain of any length is spread over many tasks.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanweave.functions.vec import hypot
from scanweave.operators.quantiles import exact_percentiles

CHAIN = ["scan_id", "chain_id"]
BLOCK = 65_536


def windowed(df: DataFrame, halo: int, exprs: dict, keys: list[str] | None = None, closed: bool = False, block: int = BLOCK) -> DataFrame:
    """Add columns computed over neighbouring rows of a chain.

    `exprs` maps a name to a function of the ordered window specification; frames may reach
    `halo` rows to either side. Closed chains continue at the other end, as often as it takes.
    """
    keys = keys or CHAIN
    names = df.columns
    at = F.array(F.col("pos").cast("long"))
    if closed:
        n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        df = df.join(n, keys)
        first, last = F.ceil((-halo - F.col("pos")) / F.col("_n")), F.floor((F.col("_n") - 1 + halo - F.col("pos")) / F.col("_n"))
        at = F.transform(F.sequence(first, last), lambda turn: F.col("pos") + turn * F.col("_n"))
    rows = df.withColumn("_p", F.explode(at))
    reach = F.array_distinct(F.array(*[F.floor((F.col("_p") + d) / block) for d in (-halo, 0, halo)]))
    rows = rows.withColumn("_block", F.explode(reach))
    spec = W.partitionBy(*keys, "_block").orderBy("_p")
    own = (F.col("_p") == F.col("pos")) & (F.col("_block") == F.floor(F.col("pos") / block))
    return rows.select("*", *[f(spec).alias(name) for name, f in exprs.items()]).filter(own).select(*names, *exprs)


def running_sums(df: DataFrame, exprs: dict[str, Column], keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Inclusive running sums along `pos`, block by block with the totals of earlier blocks."""
    keys = keys or CHAIN
    names = list(exprs)
    rows = df.select("*", *[e.alias(n) for n, e in exprs.items()]).withColumn("_block", F.floor(F.col("pos") / block))
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    outer = totals.withColumn("_outer", F.floor(F.col("_block") / block))
    coarse = outer.groupBy(*keys, "_outer").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    before = lambda spec, n: F.coalesce(F.sum(f"_{n}").over(spec.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    starts = coarse.select(*keys, "_outer", *[before(W.partitionBy(*keys).orderBy("_outer"), n).alias(f"_s_{n}") for n in names])
    offsets = outer.select(
        *keys, "_outer", "_block", *[before(W.partitionBy(*keys, "_outer").orderBy("_block"), n).alias(f"_o_{n}") for n in names]
    ).join(starts, [*keys, "_outer"]).drop("_outer")
    within = W.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.select(*df.columns, "_block", *[F.sum(n).over(within).alias(n) for n in names])
        .join(offsets, [*keys, "_block"])
        .select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}") + F.col(f"_s_{n}")).alias(n) for n in names])
    )


def arc_lengths(df: DataFrame, closed: bool) -> DataFrame:
    """Segments with their next point and the arc length at both ends (`s0`, `s1`)."""
    lead = lambda c: (lambda w: F.lead(c).over(w))
    seg = windowed(df, 1, {"u1": lead("u"), "v1": lead("v")}, closed=closed).filter("u1 IS NOT NULL")
    seg = seg.withColumn("step", hypot(F.col("u1") - F.col("u"), F.col("v1") - F.col("v")))
    return running_sums(seg, {"s1": F.col("step")}).withColumn("s0", F.col("s1") - F.col("step"))


def resample(df: DataFrame, spacing: float, closed: bool, count: int | None = None) -> DataFrame:
    """Points at equal arc length; each segment emits the targets that fall on it."""
    seg = arc_lengths(df, closed)
    total = seg.groupBy(*CHAIN).agg(F.max("s1").alias("_total"), F.max("pos").alias("_last"))
    number = F.lit(count) if count else F.greatest(F.rint(F.col("_total") / spacing), F.lit(8.0)).cast("int")
    total = total.withColumn("_count", number).withColumn(
        "_dt", F.col("_total") / (F.col("_count") if closed else F.col("_count") - 1)
    )
    seg = seg.join(total, CHAIN)
    first = F.when(F.col("pos") == 0, 0).otherwise(F.ceil(F.col("s0") / F.col("_dt")))
    stop = F.when(F.col("pos") == F.col("_last"), F.col("_count")).otherwise(F.ceil(F.col("s1") / F.col("_dt")))
    share = F.least(F.greatest((F.col("k") * F.col("_dt") - F.col("s0")) / F.greatest("step", F.lit(1e-300)), F.lit(0.0)), F.lit(1.0))
    return (
        seg.withColumn("_first", first).withColumn("_stop", stop).filter("_stop > _first")
        .withColumn("k", F.explode(F.sequence(F.col("_first"), F.col("_stop") - 1)))
        .select(
            *CHAIN, F.col("k").cast("int").alias("pos"),
            (F.col("u") + (F.col("u1") - F.col("u")) * share).alias("u"),
            (F.col("v") + (F.col("v1") - F.col("v")) * share).alias("v"),
        )
    )


def smallest_spread(n: Column, su: Column, sv: Column, suu: Column, suv: Column, svv: Column) -> Column:
    """Squared distances to the total-least-squares line of a set of points, from its sums."""
    a, c, b = suu - su * su / n, svv - sv * sv / n, suv - su * sv / n
    return F.greatest((a + c) / 2 - F.sqrt((a - c) * (a - c) / 4 + b * b), F.lit(0.0))


def local_scatter(df: DataFrame, closed: bool, width: int = 9) -> DataFrame:
    """RMS scatter about a local line for every run of `width` points."""
    sums = {"su": F.col("u"), "sv": F.col("v"), "suu": F.col("u") * F.col("u"), "suv": F.col("u") * F.col("v"), "svv": F.col("v") * F.col("v")}
    frame = lambda w: w.rowsBetween(0, width - 1)
    exprs = {n: (lambda w, e=e: F.sum(e).over(frame(w))) for n, e in sums.items()}
    exprs["n"] = lambda w: F.count("*").over(frame(w))
    rows = windowed(df, width - 1, exprs, closed=closed).filter(F.col("n") == width)
    spread = smallest_spread(F.lit(float(width)), *[F.col(c) for c in sums])
    return rows.select(*CHAIN, "pos", F.sqrt(spread / width).alias("scatter"))


def noise(df: DataFrame, closed: bool, width: int = 9) -> DataFrame:
    """Median local scatter per chain with its point count; 0 for chains shorter than the window."""
    median = exact_percentiles(local_scatter(df, closed, width), CHAIN, "scatter", {"noise": 0.5})
    counts = df.groupBy(*CHAIN).agg(F.count("*").alias("points"))
    return counts.join(median, CHAIN, "left").select(*CHAIN, "points", F.coalesce("noise", F.lit(0.0)).alias("noise"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """First value whose running weight reaches half of the total; one input row per polyline,
    equal values merged before they are ordered."""
    merged = df.groupBy(*keys, F.col(value).alias(out)).agg(F.sum(weight).alias("_w"))
    order = W.partitionBy(*keys).orderBy(out)
    upto = F.sum("_w").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_w").over(W.partitionBy(*keys))
    return merged.withColumn("_u", upto).withColumn("_t", total).filter("_u >= _t / 2").groupBy(*keys).agg(F.min(out).alias(out))


def prefix_moments(df: DataFrame) -> DataFrame:
    """Ten running sums up to and including each point: 1, u, v, uu, uv, vv, uz, vz, z, zz (z = u² + v²)."""
    u, v = F.col("u"), F.col("v")
    z = u * u + v * v
    return running_sums(df, {
        "m_n": F.lit(1.0), "m_u": u, "m_v": v, "m_uu": u * u, "m_uv": u * v, "m_vv": v * v,
        "m_uz": u * z, "m_vz": v * z, "m_z": z, "m_zz": z * z,
    })


MOMENTS = ["m_n", "m_u", "m_v", "m_uu", "m_uv", "m_vv", "m_uz", "m_vz", "m_z", "m_zz"]


def range_moments(prefix: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sums over index ranges `(…, i, j)` by two lookups in the running sums."""
    end = prefix.select(*CHAIN, F.col("pos").alias("j"), *MOMENTS)
    before = prefix.select(*CHAIN, (F.col("pos") + 1).alias("i"), *[F.col(m).alias(f"b{m}") for m in MOMENTS])
    return ranges.join(end, [*CHAIN, "j"]).join(before, [*CHAIN, "i"], "left").select(
        *ranges.columns, *[(F.col(m) - F.coalesce(f"b{m}", F.lit(0.0))).alias(m) for m in MOMENTS]
    )


def line_sse() -> Column:
    return smallest_spread(*[F.col(m) for m in MOMENTS[:6]])


def kasa_circle() -> tuple[Column, Column, Column]:
    """Centre and radius of the algebraic circle of the moment columns (Cramer's rule)."""
    n, su, sv, suu, suv, svv, suz, svz, sz, _ = (F.col(m) for m in MOMENTS)
    a, b, c = suu - su * su / n, suv - su * sv / n, svv - sv * sv / n
    p, q = (suz - su * sz / n) / 2, (svz - sv * sz / n) / 2
    det = a * c - b * b
    cu, cv = (p * c - q * b) / det, (a * q - b * p) / det
    radius = F.sqrt(cu * cu + cv * cv + (sz - 2 * cu * su - 2 * cv * sv) / n)
    return cu, cv, radius


def turning_angles(df: DataFrame, k: int) -> DataFrame:
    """Angle between the chords k samples behind and ahead, around a closed chain."""
    exprs = {
        "_pu": lambda w: F.lag("u", k).over(w), "_pv": lambda w: F.lag("v", k).over(w),
        "_nu": lambda w: F.lead("u", k).over(w), "_nv": lambda w: F.lead("v", k).over(w),
    }
    rows = windowed(df, k, exprs, closed=True)
    bu, bv = F.col("u") - F.col("_pu"), F.col("v") - F.col("_pv")
    au, av = F.col("_nu") - F.col("u"), F.col("_nv") - F.col("v")
    return rows.select(*CHAIN, "pos", F.abs(F.atan2(bu * av - bv * au, bu * au + bv * av)).alias("angle"))


def smooth(df: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing around closed chains, cut at four sigma."""
    reach = int(4.0 * sigma + 0.5)
    weights = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    total = sum(weights.values())
    mean = lambda c: (lambda w: sum((F.lag(c, -k).over(w) * (g / total) for k, g in weights.items()), F.lit(0.0)))
    rows = windowed(df, reach, {"_su": mean("u"), "_sv": mean("v")}, closed=True)
    return rows.select(*CHAIN, "pos", F.col("_su").alias("u"), F.col("_sv").alias("v"))


def loop_measures(df: DataFrame) -> DataFrame:
    """Signed area and perimeter of closed chains."""
    seg = windowed(df, 1, {"u1": lambda w: F.lead("u").over(w), "v1": lambda w: F.lead("v").over(w)}, closed=True)
    return seg.groupBy(*CHAIN).agg(
        (F.sum(F.col("u") * F.col("v1") - F.col("v") * F.col("u1")) / 2).alias("area"),
        F.sum(hypot(F.col("u1") - F.col("u"), F.col("v1") - F.col("v"))).alias("perimeter"),
    )


def peak_distance(df: DataFrame, half: int) -> DataFrame:
    """Largest sliding median of `d` around closed chains: strays shorter than the window do not count."""
    rows = windowed(df, half, {"_m": lambda w: F.percentile("d", 0.5).over(w.rowsBetween(-half, half))}, closed=True)
    return rows.groupBy(*CHAIN).agg(F.max("_m").alias("peak"))


def sorted_neighbours(df: DataFrame, keys: list[str], value: str, item: str, tol: float) -> DataFrame:
    """Neighbours in sorted order closer than `tol`: `(a, b, gap)`.

    Values are cut into buckets much wider than the tolerance; a bucket also sees the rows
    just beyond its upper end, so every close pair is found in one bucket.
    """
    width = tol * 64
    v = F.col(value)
    own = F.floor(v / width)
    rows = df.select(*keys, item, value).withColumn("_bucket", F.explode(
        F.array_distinct(F.array(own, F.floor((v - tol) / width)))
    ))
    w = W.partitionBy(*keys, "_bucket").orderBy(value, item)
    rows = rows.select(
        *keys, "_bucket", F.col(item).alias("a"), v.alias("_v"), F.lead(item).over(w).alias("b"), F.lead(value).over(w).alias("_next")
    )
    gap = F.col("_next") - F.col("_v")
    return rows.filter((F.floor(F.col("_v") / width) == F.col("_bucket")) & (gap < tol)).select(*keys, "a", "b", gap.alias("gap"))


def even_pitch(df: DataFrame, keys: list[str], angle: str, slots: int) -> DataFrame:
    """Phase of the best even division into `slots`, largest miss and number of slots in use."""
    step = 6.283185307179586 / slots
    a = F.col(angle)
    phase = df.groupBy(*keys).agg((F.atan2(F.sum(F.sin(slots * a)), F.sum(F.cos(slots * a))) / slots).alias("phase"))
    rows = df.join(phase, keys).withColumn("_k", F.rint((a - F.col("phase")) / step))
    return rows.groupBy(*keys).agg(
        F.first("phase").alias("phase"), F.count_distinct(F.pmod("_k", F.lit(slots))).alias("slots"),
        F.max(F.abs(a - F.col("phase") - F.col("_k") * step)).alias("miss"),
    )


def longest_stretch(sections: DataFrame) -> DataFrame:
    """First and last index of the run of continuing sections that holds the largest one.

    `sections(scan_id, k, area, continues)`: `continues` tells whether k + 1 goes on from k.
    A scan has a fixed number of sample sections.
    """
    w = W.partitionBy("scan_id").orderBy("k")
    broken = F.when(F.lag("continues").over(w), 0).otherwise(1)
    runs = sections.withColumn("_b", broken).withColumn("run", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("scan_id", "run").agg(
        F.min("k").alias("first"), F.max("k").alias("last"), F.max(F.struct("area", -F.col("k"))).alias("_peak")
    )
    return spans.groupBy("scan_id").agg(F.max_by(F.struct("first", "last"), "_peak").alias("_s")).select("scan_id", "_s.*")
