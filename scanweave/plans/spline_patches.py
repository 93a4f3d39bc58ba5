"""Penalised spline patches: bicubic height fields over regions of a scan.

In a cell of the knot grid the sixteen basis functions are cubic polynomials of the place in the cell,
so all their products are known from 49 moments of the points there, and the right-hand side from 16
more. These are plain sums by (patch, cell); a patch of any size costs one row per cell. The solve per
patch builds the banded normal matrix from the cells, adds the curvature penalty, and returns each
cell's polynomial, which the points meet again by cell for their signed residuals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec
from scanweave.operators.quantiles import exact_percentiles
from scanweave.session import cut, whole_groups

KEY = ["scan_id", "label"]
CELL = [*KEY, "cu", "cv"]

# Fixed values.
SPAN_LENGTH = 5.0
MIN_SPANS, MAX_SPANS = 2, 64
REFINE_FACTOR = 1.5
REFINE_GAIN = 0.05
MAX_SPREAD_DEG = 150.0
MIN_POINTS = 16
#: Share of the squared heights below which a squared residual is the rounding of its sums.
ROUNDING = 64 * np.finfo(float).eps
#: Matrix values of the patches solved together, and polynomials written at once.
SOLVED_VALUES, PIECE_ROWS = 2_000_000, 100_000
_SIGN = np.array([1.0, 0.7, 0.4])

_AXES = [f"{p}{c}" for p in ("o", "u", "v", "w") for c in "xyz"]
_MOMENTS = [f"m{a}_{b}" for a in range(7) for b in range(7)]
_RIGHT = [f"r{a}_{b}" for a in range(4) for b in range(4)]
_PIECE = [f"p{a}_{b}" for a in range(4) for b in range(4)]


def _axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames with w along the mean normal and u along the longest extent across it."""
    for b in batches:
        w = b[["sx", "sy", "sz"]].to_numpy()
        length = np.linalg.norm(w, axis=1, keepdims=True)
        w = np.where(length > 1e-12, w / np.maximum(length, 1e-300), [[0.0, 0.0, 1.0]])
        spread = np.empty((len(b), 3, 3))
        for i, p in enumerate("xyz"):
            for j, q in enumerate("xyz"):
                spread[:, i, j] = b[f"c{min(p, q)}{max(p, q)}"]
        across = np.eye(3) - w[:, :, None] * w[:, None, :]
        u = np.linalg.eigh(across @ spread @ across)[1][:, :, 2]
        u = u - (u * w).sum(1, keepdims=True) * w
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        u = u * np.where(u @ _SIGN < 0, -1.0, 1.0)[:, None]
        out = b[[*KEY, "points"]].copy()
        out[["ox", "oy", "oz"]] = b[["mx", "my", "mz"]].to_numpy()
        for name, block in (("u", u), ("v", np.cross(w, u)), ("w", w)):
            out[[f"{name}{c}" for c in "xyz"]] = block
        yield out


def patch_frames(points: DataFrame) -> DataFrame:
    """Frame of every patch of `points(scan_id, label, point_id, x, y, z, nx, ny, nz)`, with its number of points."""
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    sums = points.groupBy(*KEY).agg(
        F.count("*").alias("points"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"],
        *[F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in pairs])
    return sums.mapInPandas(_axes, "scan_id string, label int, points long, " + ", ".join(f"{c} double" for c in _AXES))


def _local(points: DataFrame, frames: DataFrame) -> DataFrame:
    d = vec() - vec("o")
    rows = points.join(frames, KEY)
    return rows.select(*KEY, "point_id", *[d.dot(vec(a)).alias(f"_{a}") for a in "uvw"], V(F.col("nx"), F.col("ny"), F.col("nz")).dot(vec("w")).alias("_lean"))


def _placed(local: DataFrame, grids: DataFrame) -> DataFrame:
    """Points with their cell and their place in it, from 0 to 1 each way."""
    rows = local.join(grids, KEY)
    out: dict[str, Column] = {}
    for a in "uv":
        at = (F.col(f"_{a}") - F.col(f"{a}0")) / (F.col(f"{a}1") - F.col(f"{a}0")) * F.col(f"n{a}")
        out[f"_a{a}"] = F.least(F.greatest(at, F.lit(0.0)), F.col(f"n{a}").cast("double"))
    rows = rows.withColumns(out)
    rows = rows.withColumns({f"c{a}": F.least(F.floor(f"_a{a}"), F.col(f"n{a}") - 1).cast("int") for a in "uv"})
    return rows.withColumns({f"_t{a}": F.col(f"_a{a}") - F.col(f"c{a}") for a in "uv"})


def _power(c: str, k: int) -> Column:
    out = F.lit(1.0)
    for _ in range(k):
        out = out * F.col(c)
    return out


def cell_moments(placed: DataFrame) -> DataFrame:
    rows = placed.withColumns({f"_{a}{k}": _power(f"_t{a}", k) for a in "uv" for k in range(7)})
    return rows.groupBy(*CELL).agg(
        *[F.sum(F.col(f"_u{a}") * F.col(f"_v{b}")).alias(f"m{a}_{b}") for a in range(7) for b in range(7)],
        *[F.sum(F.col("_w") * F.col(f"_u{a}") * F.col(f"_v{b}")).alias(f"r{a}_{b}") for a in range(4) for b in range(4)],
        F.sum(F.col("_w") * F.col("_w")).alias("ww"))


def basis_pieces(spans: int) -> np.ndarray:
    """For each span, the four clamped cubic basis functions there as polynomials of the place in it (span, function, power)."""
    knots = np.concatenate([[0.0] * 3, np.arange(spans + 1.0), [float(spans)] * 3])
    out = np.zeros((spans, 4, 4))
    for s in range(spans):
        # The recurrence of basis functions, on polynomials in t = x - s.
        held = {s + 3: np.array([1.0])}
        for degree in range(1, 4):
            raised: dict[int, np.ndarray] = {}
            for i in range(s + 3 - degree, s + 4):
                total = np.zeros(degree + 1)
                wide = knots[i + degree] - knots[i]
                if i in held and wide > 0:  # (x - knot_i) / wide
                    total[:-1] += held[i] * (s - knots[i]) / wide
                    total[1:] += held[i] / wide
                wide = knots[i + degree + 1] - knots[i + 1]
                if i + 1 in held and wide > 0:  # (knot - x) / wide
                    total[:-1] += held[i + 1] * (knots[i + degree + 1] - s) / wide
                    total[1:] -= held[i + 1] / wide
                raised[i] = total
            held = raised
        for k in range(4):
            out[s, k] = held[s + k]
    return out


def banded_solve(blocks: np.ndarray, links: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric block-tridiagonal systems (first axis): diagonal blocks, blocks above them, right-hand sides."""
    count = blocks.shape[1]
    upper, rhs = [None] * count, [None] * count
    diagonal, side = blocks[:, 0], right[:, 0]
    for k in range(count):
        if k:
            back = links[:, k - 1].transpose(0, 2, 1)
            diagonal = blocks[:, k] - back @ upper[k - 1]
            side = right[:, k] - (back @ rhs[k - 1][..., None])[..., 0]
        both = np.linalg.solve(diagonal, np.concatenate([links[:, k], side[..., None]], axis=2) if k < count - 1 else side[..., None])
        upper[k], rhs[k] = both[..., :-1], both[..., -1]
    out = [rhs[-1]]
    for k in range(count - 2, -1, -1):
        out.append(rhs[k] - (upper[k] @ out[-1][..., None])[..., 0])
    return np.concatenate(out[::-1], axis=1)


def _squared(pieces: np.ndarray) -> np.ndarray:
    """Products of a span's four functions as polynomials of degree six (span, function and function, power)."""
    out = np.zeros((len(pieces), 4, 4, 7))
    for a in range(4):
        for b in range(4):
            out[..., a + b] += pieces[:, :, None, a] * pieces[:, None, :, b]
    return out.reshape(-1, 16, 7)


def _bending(rows: int, columns: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and links of the curvature penalty."""
    width = 3 * columns
    blocks, links = np.zeros((count, width, width)), np.zeros((max(count - 1, 0), width, width))
    second_u, second_v = (np.diff(np.eye(n), 2, axis=0) for n in (rows, columns))
    bend_u, bend_v = second_u.T @ second_u, second_v.T @ second_v
    for p in range(rows):
        block, place = divmod(p, 3)
        here = slice(place * columns, (place + 1) * columns)
        blocks[block][here, here] += bend_v
        for q in range(max(0, p - 2), min(rows, p + 3)):
            other, there = divmod(q, 3)
            yonder = slice(there * columns, (there + 1) * columns)
            if other == block:
                blocks[block][here, yonder] += bend_u[p, q] * np.eye(columns)
            elif other == block + 1:
                links[block][here, yonder] += bend_u[p, q] * np.eye(columns)
    return blocks, links


def solve_patches(nu: int, nv: int, patch: np.ndarray, cu: np.ndarray, cv: np.ndarray, moments: np.ndarray, right: np.ndarray, ww: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (patch, nu + 3, nv + 3) and mean squared height residuals of patches with the same spans.

    Cells `(cu, cv)` belong to the patch numbered in `patch`; `ww` has a value per patch.
    """
    many, rows, columns = len(ww), nu + 3, nv + 3
    pu, pv = basis_pieces(nu), basis_pieces(nv)
    # Rows of coefficients in threes: a cell touches four neighbouring rows, so only neighbouring blocks.
    count = -(-rows // 3)
    width = 3 * columns
    m, r = moments.reshape(-1, 7, 7), right.reshape(-1, 4, 4)
    products = (_squared(pu)[cu] @ m @ _squared(pv)[cv].transpose(0, 2, 1)).reshape(-1, 4, 4, 4, 4)  # by p, q, x, y
    side = pu[cu] @ r @ pv[cv].transpose(0, 2, 1)
    block, place = np.divmod(cu[:, None] + np.arange(4), 3)
    at = cv[:, None] + np.arange(4)
    base = (patch[:, None] * count + block) * width + place * columns  # place of a row in a patch's right-hand side
    rhs = np.bincount((base[:, :, None] + at[:, None, :]).ravel(), side.ravel(), many * count * width).reshape(many, count, width)
    line = (base[:, :, None] + at[:, None, :])[:, :, None, :, None] * width
    flat = line + place[:, None, :, None, None] * columns + at[:, None, None, None, :]
    same = np.broadcast_to((block[:, :, None] == block[:, None, :])[..., None, None], flat.shape)
    next_ = np.broadcast_to((block[:, :, None] + 1 == block[:, None, :])[..., None, None], flat.shape)
    blocks, links = (np.bincount(flat[w], products[w], many * count * width * width).reshape(many, count, width, width) for w in (same, next_))
    links = links[:, :-1]
    points = np.bincount(patch, m[:, 0, 0], many)
    weight = (smoothing * points / (rows * columns))[:, None, None, None]
    bend, bend_links = _bending(rows, columns, count)
    tiny = 1e-12 * np.maximum(points, 1.0)[:, None, None, None] * np.eye(width)
    full = blocks + weight * bend + tiny
    # Places without a coefficient, in the last block.
    for p in range(rows, 3 * count):
        for k in range(columns):
            full[:, -1, (p % 3) * columns + k, (p % 3) * columns + k] += 1.0
    x = banded_solve(full, links + weight * bend_links, rhs)
    parts = x.reshape(many, count, width)
    square = np.einsum("kci,kci->k", (blocks @ parts[..., None])[..., 0], parts)
    square += 2 * np.einsum("kci,kci->k", (links @ parts[:, 1:, :, None])[..., 0], parts[:, :-1])
    left = ww - 2 * (parts * rhs).sum(axis=(1, 2)) + square
    # What is left of equal sums is rounding: such a residual counts as none.
    left = np.where(left <= ROUNDING * ww, 0.0, left)
    return x[:, :rows * columns].reshape(many, rows, columns), left / np.maximum(points, 1.0)


def solve_patch(nu: int, nv: int, cu: np.ndarray, cv: np.ndarray, moments: np.ndarray, right: np.ndarray, ww: float, smoothing: float) -> tuple[np.ndarray, float]:
    """Coefficients (nu + 3, nv + 3) and mean squared height residual of one patch, from its cells' sums."""
    c, mse = solve_patches(nu, nv, np.zeros(len(cu), dtype=int), np.asarray(cu), np.asarray(cv), moments, right, np.array([ww], dtype=float), smoothing)
    return c[0], float(mse[0])


def _solved(batches: Iterator[pd.DataFrame], smoothing: float) -> Iterator[pd.DataFrame]:
    """Coefficients and residual of every patch, from cells sorted by patch; patches of the same spans are solved together."""
    for b in whole_groups(batches, KEY):
        b = b.assign(_patch=(b[KEY] != b[KEY].shift()).any(axis=1).cumsum())
        for (nu, nv), part in b.groupby(["nu", "nv"]):
            nu, nv = int(nu), int(nv)
            patch = part["_patch"].factorize()[0]
            most = max(1, SOLVED_VALUES // ((nu + 5) * 3 * (nv + 3) ** 2))
            for first in range(0, patch[-1] + 1, most):
                lot = part[(patch >= first) & (patch < first + most)]
                own = lot["_patch"].factorize()[0]
                ww = np.bincount(own, lot["ww"])
                c, mse = solve_patches(nu, nv, own, lot["cu"].to_numpy(dtype=int), lot["cv"].to_numpy(dtype=int), lot[_MOMENTS].to_numpy(), lot[_RIGHT].to_numpy(), ww, smoothing)
                out = lot.drop_duplicates("_patch")[KEY].reset_index(drop=True)
                out["coefficients"], out["mse"] = list(c.reshape(len(ww), -1)), mse
                yield out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The polynomial of every cell of every patch."""
    for b in batches:
        for (nu, nv), part in b.groupby(["nu", "nv"]):
            nu, nv = int(nu), int(nv)
            pu, pv = basis_pieces(nu), basis_pieces(nv)
            most = max(1, PIECE_ROWS // (nu * nv))
            for first in range(0, len(part), most):
                lot = part.iloc[first:first + most]
                c = np.stack(lot["coefficients"].to_numpy()).reshape(-1, nu + 3, nv + 3)
                held = np.lib.stride_tricks.sliding_window_view(c, (4, 4), axis=(1, 2))
                poly = np.einsum("ipa,kijpq,jqb->kijab", pu, held, pv, optimize=True).reshape(-1, 16)
                out = pd.DataFrame(poly, columns=_PIECE)
                out.insert(0, "cv", np.tile(np.arange(nv, dtype=np.int32), nu * len(lot)))
                out.insert(0, "cu", np.tile(np.repeat(np.arange(nu, dtype=np.int32), nv), len(lot)))
                for name in reversed(KEY):
                    out.insert(0, name, np.repeat(lot[name].to_numpy(), nu * nv))
                yield out


def _heights(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Signed residual along the surface normal, to first order, of every point."""
    rows = placed.join(pieces, CELL)
    u, v = F.col("_tu"), F.col("_tv")

    def poly(terms: list[list[Column]]) -> Column:
        def nested(xs: list[Column], t: Column) -> Column:
            total = xs[-1]
            for x in reversed(xs[:-1]):
                total = total * t + x
            return total

        return nested([nested(r, v) for r in terms], u)

    c = [[F.col(f"p{a}_{b}") for b in range(4)] for a in range(4)]
    rows = rows.withColumns({
        "_h": poly(c), "_hu": poly([[c[a][b] * a for b in range(4)] for a in range(1, 4)]) * F.col("nu") / (F.col("u1") - F.col("u0")),
        "_hv": poly([[c[a][b] * b for b in range(1, 4)] for a in range(4)]) * F.col("nv") / (F.col("v1") - F.col("v0"))})
    return rows.select(*KEY, "point_id", ((F.col("_w") - F.col("_h")) / F.sqrt(1 + F.col("_hu") ** 2 + F.col("_hv") ** 2)).alias("residual"))


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(F.ceil(c), F.lit(MIN_SPANS)), F.lit(MAX_SPANS)).cast("int")


def fit_patches(points: DataFrame, smoothing: float = 0.1, margin: float = 0.0, spans: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """`(patches, residuals)` of all regions of `points(scan_id, label, point_id, x, y, z, nx, ny, nz)`.

    A patch row holds its frame, parameter rectangle, spans, `coefficients` (rows by u), `spread_deg` of
    its normals, `rms`, `max_abs` and `state`: `fitted`, `too_curved` (normals spread too far for a height
    field) or `too_few`; only fitted ones have a surface. `residuals` has every point of fitted patches.
    Without `spans`, patches start with a span for every 5 units and are refined by half as long as the
    residual falls by more than 5 %.
    """
    points = cut(points.select(*KEY, "point_id", "x", "y", "z", "nx", "ny", "nz"))
    frames = cut(patch_frames(points))
    local = cut(_local(points, frames))
    lean = exact_percentiles(local, KEY, F.least(F.greatest("_lean", F.lit(-1.0)), F.lit(1.0)), {"_cos": 0.01})
    extent = local.groupBy(*KEY).agg(*[f(f"_{a}").alias(f"{a}{k}") for a in "uv" for k, f in ((0, F.min), (1, F.max))])
    told = frames.join(extent, KEY).join(lean, KEY, "left").withColumn("spread_deg", 2 * F.degrees(F.acos("_cos"))).drop("_cos")
    state = F.when(F.col("points") < MIN_POINTS, "too_few").when(~(F.col("spread_deg") <= MAX_SPREAD_DEG), "too_curved").otherwise("fitted")
    # A patch without extent in one direction still has a rectangle.
    told = told.withColumn("state", state)
    for a in "uv":
        pad = F.greatest(F.lit(float(margin)), F.when(F.col(f"{a}1") - F.col(f"{a}0") < 1e-9, 0.5).otherwise(0.0))
        told = told.withColumns({f"{a}0": F.col(f"{a}0") - pad, f"{a}1": F.col(f"{a}1") + pad})
    told = cut(told)
    first = {f"n{a}": F.lit(max(MIN_SPANS, min(MAX_SPANS, spans["uv".index(a)]))) if spans else _clamped((F.col(f"{a}1") - F.col(f"{a}0")) / SPAN_LENGTH) for a in "uv"}
    grids = cut(told.filter("state = 'fitted'").select(*KEY, "u0", "u1", "v0", "v1").withColumns(first))
    best: DataFrame | None = None
    final: list[DataFrame] = []
    while True:
        sums = cell_moments(_placed(local, grids)).join(grids.select(*KEY, "nu", "nv"), KEY)
        cells = sums.repartition(*KEY).sortWithinPartitions(*KEY)
        found = cells.mapInPandas(lambda it: _solved(it, smoothing), "scan_id string, label int, coefficients array<double>, mse double")
        found = cut(found.join(grids, KEY))
        if best is not None:
            was = best.select(*KEY, F.col("mse").alias("_was"))
            better = F.sqrt("mse") < (1 - REFINE_GAIN) * F.sqrt("_was")
            judged = cut(found.join(was, KEY).withColumn("_better", better))
            # Patches that gained too little keep the coarser surface.
            final.append(best.join(judged.filter("NOT _better").select(*KEY), KEY, "left_semi"))
            found = judged.filter("_better").drop("_was", "_better")
        finer = found.withColumns({f"_n{a}": _clamped(F.col(f"n{a}") * REFINE_FACTOR) for a in "uv"})
        same = (F.col("_nu") == F.col("nu")) & (F.col("_nv") == F.col("nv"))
        last = same | F.lit(spans is not None) | (F.greatest("nu", "nv") >= MAX_SPANS)
        final.append(finer.filter(last).drop("_nu", "_nv"))
        best = cut(finer.filter(~last))
        if best.isEmpty():
            break
        grids = cut(best.select(*KEY, "u0", "u1", "v0", "v1", F.col("_nu").alias("nu"), F.col("_nv").alias("nv")))
        best = best.drop("_nu", "_nv")
    fitted = final[0]
    for part in final[1:]:
        fitted = fitted.unionByName(part)
    fitted = cut(fitted.drop("mse"))
    pieces = fitted.select(*KEY, "nu", "nv", "coefficients").mapInPandas(
        _pieces, "scan_id string, label int, cu int, cv int, " + ", ".join(f"{p} double" for p in _PIECE))
    residuals = cut(_heights(_placed(local, fitted.drop("coefficients")), pieces))
    quality = residuals.groupBy(*KEY).agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms"), F.max(F.abs("residual")).alias("max_abs"))
    return told.join(fitted.select(*KEY, "nu", "nv", "coefficients"), KEY, "left").join(quality, KEY, "left"), residuals
