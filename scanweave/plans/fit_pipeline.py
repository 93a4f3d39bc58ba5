"""From selected faces to design primitives: select, choose, refine, snap, judge."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.primitives import face_state, line_angle_deg, signed_distance, with_surface_normal
from scanweave.functions.snapping import snap_angle, snap_length
from scanweave.functions.vec import lit, vec
from scanweave.operators import mesh
from scanweave.operators.quantiles import robust_sigma
from scanweave.plans import constrained as cn, fits as ft
from scanweave.plans.fits import FIT, KEY
from scanweave.plans.robust import fit_robust, inliers
from scanweave.session import cut

# Fixed values.
MAX_RMS_RISE = 1.05
DIRECTION_WINDOW_DEG = 1.0
CONE_ANGLES = (15.0, 22.5, 30.0, 41.0, 45.0, 50.0, 59.0, 60.0, 75.0)
VERDICT_SHARE = 0.95
ROBUST_EPS_FACTOR = 3.0
MIN_ROBUST_EPS = 0.01
ROBUST_WIN_FACTOR = 1.02
MIN_FACES = 8

AXES = (("X", (1.0, 0.0, 0.0)), ("Y", (0.0, 1.0, 0.0)), ("Z", (0.0, 0.0, 1.0)))
#: Snaps in the order they are tried; each kind has one size.
STEPS = ("direction", "offset", "size", "minor_radius")
SNAP = "scan_id string, label int, kind string, step string, value double, measured double, uncertainty double, target string"


# ---------------------------------------------------------------- uncertainties


def uncertainties(points: DataFrame, fits: DataFrame, constraints: DataFrame) -> DataFrame:
    """Standard uncertainty of the values that the constraints leave free, per fit.

    `direction` and the half angle are in degrees; a plane's `offset` is that of its distance from the
    origin; `size` is a radius or half angle; values that are fixed, or that the kind lacks, are null.
    """
    state = fits.select(*cn._names(ft.PRIMITIVE)).join(constraints, FIT, "left")
    rows = ft._with_jacobian(points.select(*KEY, "x", "y", "z").join(fits.select(*cn._names(ft.PRIMITIVE)), KEY))
    rows = cut(rows.select(*FIT, "_r", *[f"_j{k}" for k in range(7)]))
    sums = rows.groupBy(*FIT).agg(*ft._products([F.col(f"_j{k}") for k in range(7)], "m"))
    spread = robust_sigma(rows, FIT, "_r")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, m = cn._free(b), ft._symmetric(b, "m", 7)
            own = np.einsum("kia,kij,kjb->kab", z, m, z) + np.einsum("ka,ab->kab", np.abs(z).sum(axis=1) == 0, np.eye(7))
            inverse = cn._inverse(own) * (np.abs(z).sum(axis=1) > 0)[:, :, None] * (np.abs(z).sum(axis=1) > 0)[:, None, :]
            spread_ = np.maximum(b["sigma"].to_numpy(dtype=float), 1e-6) ** 2
            cov = np.einsum("kia,kab,kjb->kij", z, inverse, z) * spread_[:, None, None]
            free = np.abs(z).max(axis=2) > 1e-9
            turns = np.linalg.matrix_rank(z[:, :2, :]) if len(b) else np.zeros(0)
            out = b[FIT].copy()
            tilt = (cov[:, 0, 0] + cov[:, 1, 1]) / np.maximum(turns, 1)
            out["direction"] = np.degrees(np.sqrt(np.where(free[:, :2].any(axis=1), tilt, np.nan)))
            o, e, g = (cn._block(b, p) for p in "oeg")
            lean = np.zeros((len(b), 7))
            lean[:, 0], lean[:, 1], lean[:, 4] = (o * e).sum(1), (o * g).sum(1), 1.0
            plane = (b["kind"] == "plane").to_numpy() & b["fixed_offset"].isna().to_numpy() & b["point_x"].isna().to_numpy()
            out["offset"] = np.sqrt(np.where(plane, np.maximum(np.einsum("ki,kij,kj->k", lean, cov, lean), 0), np.nan))
            size = np.sqrt(np.where(free[:, 5], np.maximum(cov[:, 5, 5], 0), np.nan))
            out["size"] = np.where(b["kind"] == "cone", np.degrees(size), size)
            out["minor_radius"] = np.sqrt(np.where(free[:, 6], np.maximum(cov[:, 6, 6], 0), np.nan))
            yield out

    names = ("direction", "offset", "size", "minor_radius")
    found = sums.join(spread, FIT).join(state, FIT).mapInPandas(solve, "scan_id string, label int, kind string, " + ", ".join(f"{n} double" for n in names))
    return found.select(*FIT, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


# ---------------------------------------------------------------- snaps


def _angles(direction) -> dict[str, Column]:
    return {name: line_angle_deg(direction, lit(*v)) for name, v in AXES}


def _candidates(step: str, rows: DataFrame) -> DataFrame:
    """Fits `rows` (with their constraints and uncertainties `u_*`) that a design value is in reach of: value, measured, uncertainty, target."""
    kind, none = F.col("kind"), F.lit(None).cast("string")
    if step == "direction":
        angle = _angles(vec("n"))
        free = (kind != "sphere") & F.col("direction_x").isNull() & F.col("perpendicular_x").isNull()
        ranked = F.array_sort(F.array(*[F.struct(a.alias("a"), F.lit(n).alias("n")) for n, a in angle.items()]))
        rows = rows.filter(free).withColumn("_ranked", ranked)
        near, far = F.col("_ranked")[0], F.col("_ranked")[2]
        along = snap_angle(near["a"], F.col("u_direction"), DIRECTION_WINDOW_DEG, (0.0,))
        square = snap_angle(far["a"], F.col("u_direction"), DIRECTION_WINDOW_DEG, (90.0,))
        pick = lambda name: F.when(along.isNotNull(), near[name]).otherwise(far[name])
        out = rows.withColumns({"value": F.coalesce(along, square), "measured": pick("a"), "target": pick("n"), "uncertainty": F.col("u_direction")})
    elif step == "offset":
        # An offset is a design value only of planes parallel to an origin plane.
        level = F.least(*_angles(vec("n")).values()) <= 1e-6
        free = (kind == "plane") & F.col("fixed_offset").isNull() & F.col("point_x").isNull()
        rows = rows.filter(free & level).withColumn("measured", vec("o").dot(vec("n")))
        found = snap_length(F.abs("measured"), F.col("u_offset"))
        out = rows.withColumns({"value": found["value"] * F.signum("measured"), "target": none, "uncertainty": F.col("u_offset")})
    elif step == "size":
        free = F.when(kind == "cone", F.col("fixed_half_angle").isNull()).when(kind == "plane", False).otherwise(F.col("fixed_radius").isNull())
        rows = rows.filter(free).withColumn("measured", F.when(kind == "cone", F.degrees("half_angle")).otherwise(F.col("radius")))
        length = snap_length(F.col("measured"), F.col("u_size"))["value"]
        value = F.when(kind == "cone", snap_angle(F.col("measured"), F.col("u_size"), candidates=CONE_ANGLES)).otherwise(F.when(length != 0, length))
        out = rows.withColumns({"value": value, "target": none, "uncertainty": F.col("u_size")})
    else:
        rows = rows.filter((kind == "torus") & F.col("fixed_minor_radius").isNull()).withColumn("measured", F.col("minor_radius"))
        length = snap_length(F.col("measured"), F.col("u_minor_radius"))["value"]
        out = rows.withColumns({"value": F.when(length != 0, length), "target": none, "uncertainty": F.col("u_minor_radius")})
    return out.filter(F.col("value").isNotNull()).select(*FIT, F.lit(step).alias("step"), "value", "measured", "uncertainty", "target")


def _constrained_by(constraints: DataFrame, wanted: DataFrame) -> DataFrame:
    """`constraints` with the wanted design values added."""
    names = cn._names(cn.CONSTRAINTS)
    rows = constraints.join(wanted.select(*FIT, "step", "value", "target"), FIT)
    step, value = F.col("step"), F.col("value")
    part = lambda k: F.create_map(*[F.lit(x) for n, v in AXES for x in (n, v[k])])[F.col("target")]
    new: dict[str, Column] = {}
    for k, c in enumerate("xyz"):
        new[f"direction_{c}"] = F.when((step == "direction") & (value == 0), part(k)).otherwise(F.col(f"direction_{c}"))
        new[f"perpendicular_{c}"] = F.when((step == "direction") & (value != 0), part(k)).otherwise(F.col(f"perpendicular_{c}"))
    cone = F.col("kind") == "cone"
    new["fixed_offset"] = F.when(step == "offset", value).otherwise(F.col("fixed_offset"))
    new["fixed_radius"] = F.when((step == "size") & ~cone, value).otherwise(F.col("fixed_radius"))
    new["fixed_half_angle"] = F.when((step == "size") & cone, F.radians(value)).otherwise(F.col("fixed_half_angle"))
    new["fixed_minor_radius"] = F.when(step == "minor_radius", value).otherwise(F.col("fixed_minor_radius"))
    return rows.withColumns(new).select(*names)


class Snapped(NamedTuple):
    fits: DataFrame
    snaps: DataFrame
    """Applied snaps `(…, step, value, measured, uncertainty, target)`: angles in degrees, `target` the axis of a direction."""
    constraints: DataFrame


def snap_fits(points: DataFrame, fits: DataFrame, constraints: DataFrame | None = None, steps: tuple[str, ...] = STEPS) -> Snapped:
    """Directions, offsets, radii, angles and minor radii moved to design values, one after the other.

    A value snaps when a design value lies within three uncertainties of it (at least a small floor); the
    rest of the fit is solved again under it, and the snap stays when the rms rises by at most five
    percent over the fit that came in. Values that constraints fix are left alone. `fits` carry `rms`.
    """
    names = cn._names(cn.CONSTRAINTS)
    spark = points.sparkSession
    given = constraints.select(*names) if constraints is not None else cn.constraint_rows(spark, [])
    current = cut(fits)
    held = cut(current.select(*FIT).join(given, FIT, "left").select(*names))
    limit = cut(current.select(*FIT, (MAX_RMS_RISE * F.col("rms") + 1e-12).alias("_limit")))
    snaps = spark.createDataFrame([], SNAP)
    for step in steps:
        error = uncertainties(points, current, held)
        rows = current.select(*cn._names(ft.PRIMITIVE)).join(held, FIT).join(error.select(*FIT, *[F.col(n).alias(f"u_{n}") for n in ("direction", "offset", "size", "minor_radius")]), FIT)
        wanted = cut(_candidates(step, rows))
        if wanted.isEmpty():
            continue
        tried = cut(_constrained_by(held, wanted))
        trial = cut(cn.refine_constrained(points.join(wanted.select(*KEY).distinct(), KEY, "left_semi"), current.join(wanted.select(*FIT), FIT, "left_semi"), tried))
        good = cut(trial.join(limit, FIT).filter(F.col("rms") <= F.col("_limit")).drop("_limit"))
        columns = [c for c in current.columns if c in good.columns]
        current = cut(current.select(*columns).join(good.select(*FIT), FIT, "left_anti").unionByName(good.select(*columns)))
        held = cut(held.join(good.select(*FIT), FIT, "left_anti").unionByName(tried.join(good.select(*FIT), FIT, "left_semi")))
        snaps = cut(snaps.unionByName(wanted.join(good.select(*FIT), FIT, "left_semi").select(*cn._names(SNAP))))
    return Snapped(current, snaps, held)


# ---------------------------------------------------------------- the whole job


class FitJob(NamedTuple):
    fits: DataFrame
    """Primitive, quality, `within_tolerance`, `passed`, `concave`, `face_count`, `excluded_faces` per region."""
    faces: DataFrame
    """`(scan_id, label, face_id, distance, state)` of the faces used."""
    snaps: DataFrame
    alternatives: DataFrame


def _robust(points: DataFrame, requests: DataFrame, noise: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Fits and own points of regions that hold other surfaces too."""
    eps = max(min(ROBUST_EPS_FACTOR * noise, tolerance), MIN_ROBUST_EPS)
    order = ("plane", "sphere", "cylinder", "cone")
    asked = requests.select(*KEY, F.explode(F.when(F.col("kind").isNull(), F.array(*map(F.lit, order))).otherwise(F.array("kind"))).alias("kind"))
    found = cut(fit_robust(points, asked, eps))
    # A richer kind must explain clearly more points.
    wide = found.groupBy(*KEY).agg(*[F.max(F.when(F.col("kind") == k, F.col("consensus"))).alias(f"c_{k}") for k in (*order, "torus")])
    best, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k in (*order, "torus"):
        c = F.col(f"c_{k}").cast("double")
        better = c.isNotNull() & (best.isNull() | (c > ROBUST_WIN_FACTOR * best))
        best, name = F.when(better, c).otherwise(best), F.when(better, k).otherwise(name)
    chosen = cut(found.join(wide.select(*KEY, name.alias("kind")), FIT))
    return chosen, cut(inliers(points, chosen, eps).drop("kind"))


def fit_job(vertices: DataFrame, faces: DataFrame, selection: DataFrame, requests: DataFrame, noise: float, tolerance: float = 0.1,
            constraints: DataFrame | None = None, snap: bool = True) -> FitJob:
    """Fits of selected faces `selection(scan_id, label, face_id)` as `requests(scan_id, label, kind, robust)` ask.

    A null kind is chosen automatically; `robust` regions may hold other surfaces and junk. Fits then keep
    their constraints, snap to design values, and every used face is judged by the distance of its centre:
    `pass` within the tolerance, `fail` up to three times it, else `far`. A fit passes when 95 % of its
    faces do. Synthetic faces are excluded; regions of fewer than MIN_FACES faces have no fit.
    """
    picked = selection.select(*KEY, "face_id").distinct().join(faces.select("scan_id", "face_id", "v0", "v1", "v2", "synthetic"), ["scan_id", "face_id"])
    counts = picked.groupBy(*KEY).agg(F.count_if(~F.col("synthetic")).alias("face_count"), F.count_if("synthetic").alias("excluded_faces"))
    counts = cut(counts.filter(F.col("face_count") >= MIN_FACES).join(requests.select(*KEY, "kind", "robust"), KEY))
    used = cut(picked.filter("NOT synthetic").join(counts.select(*KEY), KEY, "left_semi").drop("synthetic"))
    tri = cut(mesh.corners(vertices, faces.select("scan_id", "face_id", "v0", "v1", "v2")))
    normals = mesh.vertex_normals(vertices, tri)
    own = used.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    points = cut(own.join(normals, ["scan_id", "vertex_id"]).withColumnRenamed("vertex_id", "point_id"))

    shape = [*FIT, *ft._FRAME, *ft._SIZES, "settled", "point_count", "rms", "max_abs", "sigma", "inlier_ratio"]
    plain, messy = counts.filter("NOT robust"), counts.filter("robust")
    trials = cut(ft.fit_kinds(points.join(plain.select(*KEY), KEY, "left_semi")))
    chosen = ft.choose_kind(trials, ft.extents(points), noise).select(*KEY, F.col("kind").alias("_auto"))
    kinds = plain.select(*KEY, F.col("kind").alias("_asked")).join(chosen, KEY).select(*KEY, F.coalesce("_asked", "_auto").alias("kind"))
    fits = trials.join(kinds, FIT).select(*shape)
    alternatives = trials.select(*FIT, "rms", "settled")
    fit_points = points.join(plain.select(*KEY), KEY, "left_semi")
    if not messy.isEmpty():
        rough, near = _robust(points.join(messy.select(*KEY), KEY, "left_semi"), messy, noise, tolerance)
        fits = fits.unionByName(rough.select(*shape))
        fit_points = fit_points.unionByName(near.select(*fit_points.columns))
    fits, fit_points = cut(fits), cut(fit_points)
    if constraints is not None:
        fixed = constraints.join(fits.select(*FIT), FIT, "left_semi")
        again = cn.refine_constrained(fit_points.join(fixed.select(*KEY).distinct(), KEY, "left_semi"), fits.join(fixed.select(*FIT), FIT, "left_semi"), fixed)
        fits = cut(fits.join(fixed.select(*FIT), FIT, "left_anti").unionByName(again.select(*shape)))
    snaps = points.sparkSession.createDataFrame([], SNAP)
    if snap:
        snapped = snap_fits(fit_points, fits, constraints)
        fits, snaps = snapped.fits, snapped.snaps

    primitive = cut(fits.select(*FIT, *[f"{p}{c}" for p in "on" for c in "xyz"], *ft._SIZES))
    centre = mesh.face_geometry(tri).select("scan_id", "face_id", "gx", "gy", "gz")
    at = used.select(*KEY, "face_id").join(centre, ["scan_id", "face_id"]).join(primitive, KEY)
    distance = F.abs(signed_distance(vec("g")))
    judged = cut(at.withColumn("distance", distance).select(*KEY, "face_id", "distance", face_state(F.col("distance"), tolerance).alias("state")))
    # With other surfaces in the region, only faces of the fit's own points count: two corners of three.
    corner = used.select(*KEY, "face_id", F.explode(F.array("v0", "v1", "v2")).alias("point_id"))
    mine = corner.join(fit_points.select(*KEY, "point_id"), [*KEY, "point_id"]).groupBy(*KEY, "face_id").agg(F.count("*").alias("_own")).filter("_own >= 2")
    verdict = judged.join(mine.select(*KEY, "face_id"), [*KEY, "face_id"]).groupBy(*KEY).agg(F.avg((F.col("distance") <= tolerance).cast("double")).alias("within_tolerance"))
    facing = with_surface_normal(fit_points.select(*KEY, "x", "y", "z", *[F.col(f"n{c}").alias(f"f{c}") for c in "xyz"]).join(primitive, KEY), vec(), "s")
    hollow = facing.groupBy(*FIT).agg((F.avg(vec("s").dot(vec("f"))) < 0).alias("_concave"))
    out = fits.join(counts.select(*KEY, "face_count", "excluded_faces"), KEY).join(verdict, KEY).join(hollow, FIT)
    out = out.withColumns({"passed": F.col("within_tolerance") >= VERDICT_SHARE, "concave": F.when(F.col("kind") != "plane", F.col("_concave"))}).drop("_concave")
    return FitJob(cut(out), judged, snaps, alternatives)
