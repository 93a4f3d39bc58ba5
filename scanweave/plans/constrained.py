"""Refits of primitives under fixed values and relations.

Every round is one pass of the mergeable normal equations over all points. A fit's constraints leave
a linear space of steps: frozen parameters drop out, a direction at right angles to a given one or a
fixed plane offset tie parameters to each other, so the step is solved in the null space of these
ties. Fits of a group share a turn of their directions, a change of their size, or both: each fit
eliminates its own parameters, the small remainders are summed per group, and the shared part is
solved there. So a group of any number of regions costs one row per region, not one large system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import vec
from scanweave.operators.quantiles import robust_sigma
from scanweave.plans import fits as ft
from scanweave.plans.fits import ACTIVE, FIT, KEY
from scanweave.session import cut, cut_counting

MAX_ROUNDS = 60
SETTLED = 1e-10
#: Shared parameters of a group: a turn (three numbers) and a size.
SHARED = 4

#: Nullable columns of a constraint row besides `scan_id, label, kind`.
VALUES = [*(f"direction_{c}" for c in "xyz"), *(f"perpendicular_{c}" for c in "xyz"), *(f"point_{c}" for c in "xyz"),
          "fixed_radius", "fixed_minor_radius", "fixed_half_angle", "fixed_offset"]
CONSTRAINTS = ("scan_id string, label int, kind string, " + ", ".join(f"{v} double" for v in VALUES)
               + ", tie long, same_direction boolean, same_size boolean")
_STATE = f"{ft.PRIMITIVE}, " + CONSTRAINTS.split("kind string, ")[1]


def _block(b: pd.DataFrame, prefix: str) -> np.ndarray:
    return b[[f"{prefix}{c}" for c in "xyz"]].to_numpy(dtype=float)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _pinned(b: pd.DataFrame) -> pd.DataFrame:
    """The primitives moved onto their fixed values and relations."""
    o, n = _block(b, "o"), _unit(_block(b, "n"))
    fixed, square, point = _block(b, "direction_"), _unit(_block(b, "perpendicular_")), _block(b, "point_")
    known = np.isfinite(fixed).all(axis=1)
    turned = _unit(fixed)
    turned = turned * np.where((turned * n).sum(axis=1) < 0, -1.0, 1.0)[:, None]
    n = np.where(known[:, None], turned, n)
    right = np.isfinite(square).all(axis=1) & ~known
    flat = n - (n * square).sum(axis=1)[:, None] * square
    # A direction along the given one starts at any right angle to it.
    helper = np.cross(square, np.where(np.abs(square[:, :1]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]]))
    flat = np.where(np.linalg.norm(flat, axis=1, keepdims=True) < 1e-9, helper, flat)
    n = np.where(right[:, None], _unit(flat), n)
    o = np.where(np.isfinite(point).all(axis=1)[:, None], point, o)
    offset = b["fixed_offset"].to_numpy(dtype=float)
    level = np.isfinite(offset) & (b["kind"] == "plane").to_numpy()
    o = np.where(level[:, None], o - ((o * n).sum(axis=1) - offset)[:, None] * n, o)
    e, g = ft._frames(n)
    out = b.copy()
    for name, block in (("o", o), ("n", n), ("e", e), ("g", g)):
        out[[f"{name}{c}" for c in "xyz"]] = block
    for value in ("radius", "minor_radius", "half_angle"):
        out[value] = b[f"fixed_{value}"].where(b[f"fixed_{value}"].notna(), b[value])
    return out


def _free(b: pd.DataFrame) -> np.ndarray:
    """For each fit, orthonormal columns that span its allowed steps (7 x 7, unused columns zero)."""
    active = np.array([ACTIVE[k] for k in b["kind"]], dtype=bool)
    active[np.isfinite(_block(b, "direction_")).all(axis=1), :2] = False
    active[np.isfinite(_block(b, "point_")).all(axis=1), 2:5] = False
    size = np.where(b["kind"] == "cone", b["fixed_half_angle"], b["fixed_radius"]).astype(float)
    active[np.isfinite(size), 5] = False
    active[np.isfinite(b["fixed_minor_radius"].to_numpy(dtype=float)), 6] = False
    # The shared part of a group moves these instead.
    shared = b["tie"].notna().to_numpy()
    active[shared & b["same_direction"].fillna(False).to_numpy(dtype=bool), :2] = False
    active[shared & b["same_size"].fillna(False).to_numpy(dtype=bool), 5] = False
    o, e, g = (_block(b, p) for p in "oeg")
    square = _block(b, "perpendicular_")
    ties = np.zeros((len(b), 2, 7))
    right = np.isfinite(square).all(axis=1)
    ties[right, 0, 0], ties[right, 0, 1] = (square * e).sum(1)[right], (square * g).sum(1)[right]
    level = np.isfinite(b["fixed_offset"].to_numpy(dtype=float)) & (b["kind"] == "plane").to_numpy()
    ties[level, 1, 0], ties[level, 1, 1], ties[level, 1, 4] = (o * e).sum(1)[level], (o * g).sum(1)[level], 1.0
    # Null space of the ties and of the frozen parameters.
    rows = np.concatenate([ties * active[:, None, :], np.where(active[:, :, None], 0.0, np.eye(7)[None])], axis=1)
    values, vectors = np.linalg.eigh(np.einsum("kri,krj->kij", rows, rows))
    return np.where(values[:, None, :] < 1e-12, vectors, 0.0)


def _shared(b: pd.DataFrame) -> np.ndarray:
    """For each fit, how the shared turn and size of its group move its seven parameters."""
    out = np.zeros((len(b), 7, SHARED))
    n, e, g = (_block(b, p) for p in "neg")
    tied = b["tie"].notna().to_numpy()
    turn = tied & b["same_direction"].fillna(False).to_numpy(dtype=bool)
    # A turn w moves the axis by w x n, seen along e and g.
    out[turn, 0, :3], out[turn, 1, :3] = np.cross(n, e)[turn], np.cross(n, g)[turn]
    out[tied & b["same_size"].fillna(False).to_numpy(dtype=bool), 5, 3] = 1.0
    active = np.array([ACTIVE[k] for k in b["kind"]], dtype=bool)
    return out * active[:, :, None]


def _inverse(m: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-300))
    scaled = m / scale[:, :, None] / scale[:, None, :]
    return np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) / scale[:, :, None] / scale[:, None, :]


def _parts(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    m, v = ft._symmetric(b, "m", 7), b[[f"v_{i}" for i in range(7)]].to_numpy()
    z, s = _free(b), _shared(b)
    own = np.einsum("kia,kij,kjb->kab", z, m, z)
    # Unused columns of z are zero; a unit diagonal keeps them out of the way.
    own += np.einsum("ka,ab->kab", np.abs(z).sum(axis=1) == 0, np.eye(7))
    return m, v, z, s, _inverse(own)


def _remainders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of a fit's equations for its group after its own parameters are eliminated."""
    for b in batches:
        m, v, z, s, own = _parts(b)
        cross = np.einsum("kia,kij,kjb->kab", z, m, s)
        left = np.einsum("kia,kij,kjb->kab", s, m, s) - np.einsum("kax,kab,kby->kxy", cross, own, cross)
        right = np.einsum("kia,ki->ka", s, v) - np.einsum("kax,kab,kb->kx", cross, own, np.einsum("kia,ki->ka", z, v))
        out = b[["scan_id", "tie"]].copy()
        for i in range(SHARED):
            out[f"t_{i}"] = right[:, i]
            for j in range(i, SHARED):
                out[f"s_{i}_{j}"] = left[:, i, j]
        yield out


_LEFT = [f"s_{i}_{j}" for i in range(SHARED) for j in range(i, SHARED)] + [f"t_{i}" for i in range(SHARED)]


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fits after one step; `moved` is its largest part, negative when there is no finite step."""
    for b in batches:
        m, v, z, s, own = _parts(b)
        shared = np.zeros((len(b), SHARED))
        tied = b["s_0_0"].notna().to_numpy()
        if tied.any():
            group = b[tied]
            shared[tied] = -np.einsum("kab,kb->ka", _inverse(ft._symmetric(group, "s", SHARED)), group[[f"t_{i}" for i in range(SHARED)]].to_numpy())
        common = np.einsum("kia,ka->ki", s, shared)
        pull = np.einsum("kia,ki->ka", z, v + np.einsum("kij,kj->ki", m, common))
        step = common - np.einsum("kia,kab,kb->ki", z, own, pull)
        # A group turns as one, so a group's long step is not shortened fit by fit.
        limit = np.where(tied, 1.0, np.minimum(1.0, 0.3 / np.maximum(np.abs(step[:, :2]).max(1), 1e-300)))
        step, shared = step * limit[:, None], shared * limit[:, None]
        stuck = ~np.isfinite(step).all(axis=1) | ~np.isfinite(shared).all(axis=1)
        step[stuck], shared[stuck] = 0.0, 0.0
        o, n, e, g = (_block(b, p) for p in "oneg")
        out = b.copy()
        o = o + step[:, 2:3] * e + step[:, 3:4] * g + step[:, 4:5] * n
        turn = tied & b["same_direction"].fillna(False).to_numpy(dtype=bool)
        w = shared[:, :3]
        axis = np.where(turn[:, None], _rotated(n, w), n + step[:, :1] * e + step[:, 1:2] * g)
        out[["ox", "oy", "oz"]], out[["nx", "ny", "nz"]] = o, _unit(axis)
        cone = (b["kind"] == "cone").to_numpy()
        out["radius"] = b["radius"].to_numpy() + np.where(cone, 0.0, step[:, 5])
        out["half_angle"] = b["half_angle"].to_numpy() + np.where(cone, step[:, 5], 0.0)
        out["minor_radius"] = b["minor_radius"].to_numpy() + step[:, 6]
        out = _pinned(out)
        out["moved"] = np.where(stuck, ft.STUCK, np.abs(step).max(axis=1))
        yield out[[*_names(_STATE), "scale", "moved"]]


def _rotated(n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """`n` turned by the rotation vector `w`: equal directions stay equal."""
    angle = np.linalg.norm(w, axis=1, keepdims=True)
    axis = w / np.maximum(angle, 1e-300)
    along = (axis * n).sum(axis=1, keepdims=True) * axis
    return along + (n - along) * np.cos(angle) + np.cross(axis, n) * np.sin(angle)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _levelled(fits: DataFrame, counts: DataFrame) -> DataFrame:
    """Fits of a group moved to one direction (sign kept) and one size: means weighted by points."""
    rows = fits.join(counts, KEY)
    tied = F.col("tie").isNotNull()
    lead = rows.filter(tied).groupBy("scan_id", "tie").agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("label", "kind")).alias("_lead"))
    rows = rows.join(lead, ["scan_id", "tie"], "left")
    facing = F.when(sum((F.col(f"n{c}") * F.col(f"_lead.n{c}") for c in "xyz"), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    rows = cut(rows.withColumn("_facing", facing).drop("_lead"))
    size = F.when(F.col("kind") == "cone", F.col("half_angle")).otherwise(F.col("radius"))
    means = rows.filter(tied).groupBy("scan_id", "tie").agg(
        *[F.sum(F.col(f"n{c}") * F.col("_facing") * F.col("_n")).alias(f"_d{c}") for c in "xyz"], (F.sum(size * F.col("_n")) / F.sum("_n")).alias("_size"))
    rows = rows.join(means, ["scan_id", "tie"], "left")
    length = F.sqrt(sum((F.col(f"_d{c}") ** 2 for c in "xyz"), F.lit(0.0)))
    turn, same = tied & F.coalesce("same_direction", F.lit(False)), tied & F.coalesce("same_size", F.lit(False))
    cone = F.col("kind") == "cone"
    return rows.withColumns({
        **{f"n{c}": F.when(turn, F.col(f"_d{c}") / length * F.col("_facing")).otherwise(F.col(f"n{c}")) for c in "xyz"},
        "radius": F.when(same & ~cone, F.col("_size")).otherwise(F.col("radius")),
        "half_angle": F.when(same & cone, F.col("_size")).otherwise(F.col("half_angle"))}).select(*_names(_STATE))


def refine_constrained(points: DataFrame, fits: DataFrame, constraints: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """`fits` refined with the soft-L1 loss while they keep their constraints; with `settled` and the quality columns.

    `constraints` has a row for each fit that keeps something: null values are free. `direction` is a
    plane normal or an axis, `perpendicular` a vector at right angles to it, `point` lies on the plane
    or axis or is the apex or centre, `offset` is a plane's signed distance from the origin. Fits of one
    `tie` within a scan share their direction (up to sign) or their size or both; a fit cannot both share
    a direction and keep one of its own. Fits without a row are refined freely.
    """
    points = cut(points.select(*KEY, "x", "y", "z"))
    given = constraints.select(*_names(CONSTRAINTS))
    own = fits.select(*_names(ft.PRIMITIVE)).join(given, FIT, "left").select(*_names(_STATE))
    counts = points.groupBy(*KEY).agg(F.count("*").alias("_n"))
    start = cut(_levelled(own, counts).mapInPandas(lambda it: map(_pinned, it), _STATE))
    near, large = ft.held_regions(points)
    first = cut(ft._with_jacobian(ft.meeting(near, large, start.drop("tie", "same_direction", "same_size", *VALUES))).select(*FIT, "_r"))
    scale = robust_sigma(first.filter(ft.finite("_r")), FIT, "_r", "scale").select(*FIT, F.greatest("scale", F.lit(1e-3)).alias("scale"))
    current = cut(start.join(scale, FIT, "left").withColumn("scale", F.coalesce("scale", F.lit(1e-3))))
    schema, done = f"{_STATE}, scale double, moved double", []
    for _ in range(rounds):
        sums = ft.weighted_sums(ft._with_jacobian(ft.meeting(near, large, current.select(*_names(ft.PRIMITIVE), "scale")))).drop("loss")
        # Read twice below: by the groups and by the steps.
        equations = cut(sums.join(current, FIT))
        left = equations.filter("tie IS NOT NULL").mapInPandas(_remainders, "scan_id string, tie long, " + ", ".join(f"{c} double" for c in _LEFT))
        groups = left.groupBy("scan_id", "tie").agg(*[F.sum(c).alias(c) for c in _LEFT])
        stepped = cut(equations.join(groups, ["scan_id", "tie"], "left").mapInPandas(_moved, schema))
        # A group settles as a whole.
        most = stepped.filter("tie IS NOT NULL").groupBy("scan_id", "tie").agg(F.max("moved").alias("_most"))
        judged, moving = cut_counting(stepped.join(most, ["scan_id", "tie"], "left").withColumn("_most", F.coalesce("_most", "moved")), F.coalesce("_most", "moved") > SETTLED)
        done.append(judged.filter(F.col("_most") <= SETTLED).withColumn("settled", F.col("moved") >= 0))
        current = judged.filter(F.col("_most") > SETTLED)
        if not moving:
            break
        current = current.drop("moved", "_most")
    near.unpersist()
    result = current.withColumn("settled", F.lit(False)).select(*_names(ft.PRIMITIVE), "settled")
    for part in done:
        result = result.unionByName(part.select(*_names(ft.PRIMITIVE), "settled"))
    return ft.with_quality(points, cut(result))


def constraint_rows(spark, rows: list[dict]) -> DataFrame:
    """A constraint table from dictionaries that name only what is kept."""
    names = _names(CONSTRAINTS)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], CONSTRAINTS)
