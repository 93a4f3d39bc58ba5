"""Plane frames, constructed planes and axes, quadric tops, part-frame adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.primitives import PARALLEL_DEG, line_angle_deg
from scanweave.functions.vec import V, hypot, lit, pick, stage, vec

# In-plane X and Y of the standard planes.
STANDARD_FRAMES = {"XY": ((1, 0, 0), (0, 1, 0)), "YZ": ((0, 1, 0), (0, 0, 1)), "XZ": ((1, 0, 0), (0, 0, 1))}


def to_plane(p: V, origin: V, x: V, y: V) -> tuple[Column, Column]:
    d = p - origin
    return d.dot(x), d.dot(y)


def from_plane(u: Column, v: Column, origin: V, x: V, y: V) -> V:
    return origin + x * u + y * v


def fold(p: V, origin: V, axis: V) -> tuple[Column, Column]:
    """Distance along an axis and from it."""
    d = p - origin
    h = d.dot(axis)
    return h, F.sqrt(F.greatest(d.dot(d) - h * h, F.lit(0.0)))


def offset_plane(origin: V, normal: V, distance: Column) -> tuple[V, V]:
    n = normal.unit()
    return origin + n * distance, n


def _tidy(df: DataFrame, names: list[str], keep: str = "") -> DataFrame:
    """Drop the helper columns a staged formula left behind."""
    wanted = lambda c: c in names or not c.startswith("_") or (keep and c[:-1] == keep)
    return df.select(*[c for c in df.columns if wanted(c)])


def plane_through_axis(df: DataFrame, direction: V, angle_deg: Column, out: str) -> DataFrame:
    """Normal `<out>*` of the plane that holds an axis at an angle from X (Y within 45° of X)."""
    names = df.columns
    df = stage(df, _a=direction.unit())
    a, t = vec("_a"), F.radians(angle_deg)
    ref = pick(F.abs(a.x) < F.sqrt(F.lit(0.5)), lit(1, 0, 0), lit(0, 1, 0))
    df = stage(df, _f=ref - a * ref.dot(a))
    df = stage(df, _u=vec("_f").unit())
    df = stage(df, _n=a.cross(vec("_u") * F.cos(t) + a.cross(vec("_u")) * F.sin(t)))
    return _tidy(stage(df, **{out: vec("_n").unit()}), names)


def mid_plane(df: DataFrame, oa: V, na: V, ob: V, nb: V, out: str) -> DataFrame:
    """Half way between two parallel planes: origin `<out>*`, normal `<out>n*`, `<out>_status`."""
    names = df.columns
    df = stage(df, _a=na.unit(), _b=nb.unit())
    a, b = vec("_a"), vec("_b")
    df = stage(df, _s=a + b * F.signum(a.dot(b)))
    status = F.when(line_angle_deg(a, b) > PARALLEL_DEG, "not_parallel").otherwise("ok")
    on_b = oa - b * (oa - ob).dot(b)
    return _tidy(stage(df, **{out: (oa + on_b) * 0.5, f"{out}n": vec("_s").unit()}).withColumn(f"{out}_status", status), names)


def axis_of_planes(df: DataFrame, oa: V, na: V, ob: V, nb: V, near: V, out: str) -> DataFrame:
    """Common line of two planes: point `<out>*` nearest `near`, direction `<out>d*`, `<out>_status`."""
    names = df.columns
    df = stage(df, _a=na.unit(), _b=nb.unit())
    a, b = vec("_a"), vec("_b")
    df = stage(df, _c=a.cross(b))
    df = stage(df, **{f"{out}d": vec("_c").unit()})
    d = vec(f"{out}d")
    df = stage(df, _x=b.cross(d), _y=d.cross(a))
    det = a.dot(vec("_x"))
    point = (vec("_x") * a.dot(oa) + vec("_y") * b.dot(ob) + vec("_c") * d.dot(near)) / F.when(det == 0, 1.0).otherwise(det)
    status = F.when(line_angle_deg(a, b) < PARALLEL_DEG, "parallel_planes").otherwise("ok")
    return _tidy(stage(df, **{out: point}).withColumn(f"{out}_status", status), names)


def in_plane(df: DataFrame, normal: V, out: str, hint: V | None = None) -> DataFrame:
    """The hint (then global X, then Y) projected into the plane of a unit normal, `<out>*`."""
    names = df.columns
    options = ([hint] if hint is not None else []) + [lit(1, 0, 0), lit(0, 1, 0)]
    chosen = V(*[F.lit(None).cast("double")] * 3)
    for option in reversed(options):
        flat = option - normal * option.dot(normal)
        chosen = pick(flat.norm() > 1e-6, flat, chosen)
    df = stage(df, _flat=chosen)
    return _tidy(stage(df, **{out: vec("_flat") / vec("_flat").norm()}), names, out)


def plane_frame(df: DataFrame, origin: V, normal: V, offset: Column, flip: Column, out: str) -> DataFrame:
    """Sketch frame on an offset, maybe flipped plane: `<out>o*`, `<out>x*`, `<out>n*`."""
    names = df.columns
    df = stage(df, _n=normal.unit())
    df = in_plane(df, vec("_n"), f"{out}x")
    return _tidy(stage(df, **{f"{out}o": origin + vec("_n") * offset, f"{out}n": pick(flip, -vec("_n"), vec("_n"))}), names)


def rotational_frame(df: DataFrame, point: V, direction: V, angle_deg: Column, out: str) -> DataFrame:
    """Half-plane frame with X along an axis, at an angle from global Z (else X)."""
    names = df.columns
    df = stage(df, _a=direction.unit())
    df = in_plane(df, vec("_a"), "_p", lit(0, 0, 1))
    a, p, t = vec("_a"), vec("_p"), F.radians(angle_deg)
    df = stage(df, _q=p * F.cos(t) + a.cross(p) * F.sin(t))
    frame = {f"{out}o": point - a * point.dot(a), f"{out}x": a, f"{out}n": a.cross(vec("_q"))}
    return _tidy(stage(df, **frame), names)


def top_height(c: list[Column], u: Column, v: Column) -> Column:
    return c[0] + c[1] * u + c[2] * v + c[3] * u * u + c[4] * u * v + c[5] * v * v


def top_gradient(c: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    return c[1] + 2 * c[3] * u + c[4] * v, c[2] + c[4] * u + 2 * c[5] * v


def top_tilt(c: list[Column]) -> Column:
    return F.atan(hypot(c[1], c[2]))


def adjusted(p: V, flip_z: Column, flip_x: Column, quarters: Column) -> V:
    """Part-frame adjustment: half turn about X, half turn about Z, quarter turns about Z."""
    z = pick(flip_z, V(p.x, -p.y, -p.z), p)
    x = pick(flip_x, V(-z.x, -z.y, z.z), z)
    q = F.pmod(quarters, F.lit(4))
    return pick(q == 1, V(-x.y, x.x, x.z), pick(q == 2, V(-x.x, -x.y, x.z), pick(q == 3, V(x.y, -x.x, x.z), x)))
