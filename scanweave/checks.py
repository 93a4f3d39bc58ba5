"""The fixture tables of `fixtures.py` as SQL, for the check statements."""

from __future__ import annotations

import re

from scanweave.fixtures import BOX_TRIANGLES

_BOX = " UNION ALL ".join(
    f"SELECT {n} AS n, {a} AS t0, {b} AS t1, {c} AS t2" for n, (a, b, c) in enumerate(BOX_TRIANGLES)
)

CTES: dict[str, str] = {
    "grid": """SELECT 'scan_' || ((((o_orderkey // 100) // 10) * 10 + (o_orderkey % 100) // 10) % 5) AS scan_id,
        o_orderkey AS k, o_orderkey % 100 AS i, o_orderkey // 100 AS j,
        ((o_orderkey // 100) // 10) * 10 + (o_orderkey % 100) // 10 AS tile,
        round(o_totalprice % 1000, 2) / 10000 AS z FROM orders""",
    "vertices": "SELECT scan_id, k AS vertex_id, i::DOUBLE AS x, j::DOUBLE AS y, z FROM grid",
    "tiled_faces": """SELECT scan_id, tile, 2 * k + h AS face_id, k AS v0,
        CASE WHEN h = 0 THEN k + 1 ELSE k + 101 END AS v1, CASE WHEN h = 0 THEN k + 101 ELSE k + 100 END AS v2
        FROM grid, (VALUES (0), (1)) t(h)
        WHERE i % 10 < 9 AND j % 10 < 9 AND k + 101 < (SELECT count(*) FROM orders)""",
    "faces": "SELECT scan_id, face_id, v0, v1, v2, face_id % 41 = 0 AS synthetic FROM tiled_faces",
    "dirty_base": """SELECT scan_id, face_id, CASE WHEN face_id % 31 = 0 THEN v2 ELSE v0 END AS v0, v1,
        CASE WHEN face_id % 31 = 0 THEN v0 ELSE v2 END AS v2 FROM tiled_faces""",
    "dirty_faces": """SELECT scan_id, face_id, v0, v1, v2 FROM dirty_base
        UNION ALL SELECT scan_id, face_id + 1000000000, v2, v1, v0 FROM dirty_base WHERE face_id % 97 = 0
        UNION ALL SELECT scan_id, face_id + 2000000000, v0, v0, v2 FROM dirty_base WHERE face_id % 89 = 0""",
    "tri": """SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz,
        c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN vertices a ON a.vertex_id = f.v0
        JOIN vertices b ON b.vertex_id = f.v1 JOIN vertices c ON c.vertex_id = f.v2""",
    "geo": """SELECT *, (ax + bx + cx) / 3 AS gx, (ay + by_ + cy) / 3 AS gy, (az + bz + cz) / 3 AS gz,
        (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS kx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ky,
        (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS kz FROM tri""",
    "normals": """SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS d, kx / sqrt(kx * kx + ky * ky + kz * kz) AS nx,
        ky / sqrt(kx * kx + ky * ky + kz * kz) AS ny, kz / sqrt(kx * kx + ky * ky + kz * kz) AS nz,
        0.5::DOUBLE * sqrt(kx * kx + ky * ky + kz * kz) AS area FROM geo""",
    "half_edges": """SELECT scan_id, face_id, v0 AS src, v1 AS dst, 0 AS slot FROM faces
        UNION ALL SELECT scan_id, face_id, v1, v2, 1 FROM faces UNION ALL SELECT scan_id, face_id, v2, v0, 2 FROM faces""",
    "edges": """SELECT scan_id, least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS valence,
        min(face_id) AS fa, max(face_id) AS fb, count(DISTINCT src) AS directions FROM half_edges GROUP BY ALL""",
    "pairs": "SELECT scan_id, fa, fb, directions = 2 AS consistent, lo, hi FROM edges WHERE valence = 2",
    "links": """SELECT scan_id, fa AS face_id, fb AS other FROM pairs
        UNION ALL SELECT scan_id, fb, fa FROM pairs""",
    "soup": """SELECT scan_id, face_id, CASE WHEN face_id % 53 = 0 THEN 'NaN'::DOUBLE ELSE ax END AS ax, ay, az,
        bx, by_, bz, cx, cy, CASE WHEN face_id % 59 = 0 THEN 'Infinity'::DOUBLE ELSE cz END AS cz FROM tri""",
    "region_labels": """SELECT scan_id, face_id, CASE WHEN face_id % 7 = 0 THEN 0 ELSE tile * 4
        + ((face_id // 2) % 10) // 5 + 2 * ((((face_id // 2) // 100) % 10) // 5) + 1 END AS label FROM tiled_faces""",
    "selection": """SELECT scan_id, face_id FROM tiled_faces
        WHERE (face_id // 2) % 10 < 5 AND face_id % 3 <> 0""",
    "other_selection": "SELECT scan_id, face_id FROM tiled_faces WHERE face_id % 5 <> 0",
    "boxes": """SELECT 'scan_' || (p_partkey % 5) AS scan_id, p_partkey AS body, ((p_partkey % 100) * 60)::DOUBLE AS x0,
        ((p_partkey // 100) * 60)::DOUBLE AS y0, 0.0::DOUBLE AS z0, p_size::DOUBLE AS dx, (p_size % 7 + 1)::DOUBLE AS dy,
        (p_size % 5 + 1)::DOUBLE AS dz FROM part""",
    "box_vertices": """SELECT scan_id, body, body * 8 + c AS vertex_id, x0 + dx * (c % 2) AS x,
        y0 + dy * ((c // 2) % 2) AS y, z0 + dz * (c // 4) AS z FROM boxes, range(8) t(c)""",
    "box_faces": f"""SELECT scan_id, body, body * 12 + n AS face_id, body * 8 + t0 AS v0,
        CASE WHEN body % 10 = 3 THEN body * 8 + t2 ELSE body * 8 + t1 END AS v1,
        CASE WHEN body % 10 = 3 THEN body * 8 + t1 ELSE body * 8 + t2 END AS v2 FROM boxes, ({_BOX}) b""",
    "box_tri": """SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz,
        c.x AS cx, c.y AS cy, c.z AS cz FROM box_faces f JOIN box_vertices a ON a.vertex_id = f.v0
        JOIN box_vertices b ON b.vertex_id = f.v1 JOIN box_vertices c ON c.vertex_id = f.v2""",
    "box_points": """SELECT b.scan_id, ((l_orderkey * 8 + l_linenumber) * 100000 + body) * 64 + l_quantity::BIGINT AS vertex_id, body, x0 + dx * (l_quantity / 40 - 0.113::DOUBLE) AS x,
        y0 + dy * (l_discount * 12 - 0.107::DOUBLE) AS y, z0 + dz * (l_tax * 14 - 0.059::DOUBLE) AS z, x0, y0, z0, dx, dy, dz FROM lineitem
        JOIN boxes b ON b.body = l_partkey""",
    "cloud": """SELECT 'scan_' || (vec_id % 5) AS scan_id, vec_id AS point_id, embedding[1]::DOUBLE AS x,
        embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label + 1 AS label FROM embeddings""",
    "polylines": """SELECT 'scan_' || ((o_orderkey // 100) % 5) AS scan_id, o_orderkey // 100 AS chain_id,
        o_orderkey % 100 AS pos, o_orderkey % 100 + round(o_totalprice % 100, 2) / 500 AS u,
        round(o_totalprice % 1000, 2) / 500 AS v FROM orders""",
    "loops": """SELECT scan_id, chain_id, pos, (5 + v / 10 + chain_id % 7) * cos(pos * 2 * 3.141592653589793::DOUBLE / 100) AS u,
        (5 + v / 10 + chain_id % 7) * sin(pos * 2 * 3.141592653589793::DOUBLE / 100) AS v FROM polylines""",
    "region_pairs": """SELECT 'scan_' || ((o_orderkey // 5000) % 5) AS scan_id, o_orderkey AS face_id,
        o_orderkey // 50 AS old_label, (o_orderkey + 7) // 50 AS new_label FROM orders""",
    "deviations": """SELECT 'scan_' || (l_orderkey % 5) AS scan_id, l_orderkey * 8 + l_linenumber AS vertex_id,
        CASE WHEN l_linenumber <> 7 THEN (l_quantity - 25) / 250 END AS signed,
        'body_' || (l_suppkey % 3) AS body, l_suppkey AS face_id FROM lineitem""",
    "primitives": """SELECT 'scan_' || ((s_suppkey // 5) % 5) AS scan_id, s_suppkey::INT AS label,
        (['plane', 'cylinder', 'sphere', 'cone', 'torus'])[s_suppkey % 5 + 1] AS kind,
        (s_suppkey % 11)::DOUBLE AS ox, (s_suppkey % 13)::DOUBLE AS oy, 0.5::DOUBLE AS oz,
        0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 1.0::DOUBLE AS nz, (s_suppkey % 4 + 5)::DOUBLE AS radius,
        1.5::DOUBLE AS minor_radius, 0.3::DOUBLE + (s_suppkey % 3) * 0.1::DOUBLE AS half_angle FROM supplier""",
    "patch_raw": """SELECT p.scan_id, p.label, p.kind, l_orderkey * 8 + l_linenumber AS point_id, ox, oy, oz, radius AS r,
        minor_radius AS mr, half_angle AS ha, (l_partkey % 360) * 3.141592653589793::DOUBLE / 180 AS a, l_quantity / 10 AS h,
        (round(l_extendedprice % 100, 0) - 50) / 2500 AS e FROM lineitem JOIN primitives p ON p.label = l_suppkey""",
    "patch_polar": """SELECT *, CASE kind WHEN 'plane' THEN h WHEN 'cylinder' THEN r + e WHEN 'sphere' THEN (r + e) * sin(h / 2 + 0.3::DOUBLE)
        WHEN 'cone' THEN (h + 1) * tan(ha) + e * cos(ha) ELSE r + (mr + e) * cos(h) END AS rho,
        CASE kind WHEN 'plane' THEN e WHEN 'cylinder' THEN h WHEN 'sphere' THEN (r + e) * cos(h / 2 + 0.3::DOUBLE)
        WHEN 'cone' THEN (h + 1) - e * sin(ha) ELSE (mr + e) * sin(h) END AS zz,
        CASE kind WHEN 'plane' THEN 0 WHEN 'cylinder' THEN 1 WHEN 'sphere' THEN sin(h / 2 + 0.3::DOUBLE)
        WHEN 'cone' THEN cos(ha) ELSE cos(h) END::DOUBLE AS nr,
        CASE kind WHEN 'plane' THEN 1 WHEN 'cylinder' THEN 0 WHEN 'sphere' THEN cos(h / 2 + 0.3::DOUBLE)
        WHEN 'cone' THEN -sin(ha) ELSE sin(h) END::DOUBLE AS na FROM patch_raw""",
    "patch_points": """SELECT scan_id, label, kind, point_id, ox + rho * cos(a) AS x, oy + rho * sin(a) AS y, oz + zz AS z,
        nr * cos(a) AS nx, nr * sin(a) AS ny, na AS nz FROM patch_polar""",
}


def _needs(text: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", text)]


def sql(body: str, **extra: str) -> str:
    """`body` with the fixture tables it names (directly or through `extra`) put in front."""
    chosen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in chosen:
            return
        for need in _needs(CTES[name]):
            if need != name:
                add(need)
        chosen[name] = CTES[name]

    for text in [*extra.values(), body]:
        for name in _needs(text):
            if name not in extra:
                add(name)
    chosen.update(extra)
    if not chosen:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in chosen.items()) + "\n" + body


def r(expression: str, digits: int = 6) -> str:
    """Rounded measure without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


# ---------------------------------------------------------------- vector text helpers


def sv(prefix: str = "", suffix: str = "") -> tuple[str, str, str]:
    # `by` is a keyword; the corner tables call it `by_`.
    names = [f"{prefix}{n}{suffix}" for n in "xyz"]
    return tuple("by_" if n == "by" else n for n in names)


def sdot(a, b) -> str:
    return "(" + " + ".join(f"({p}) * ({q})" for p, q in zip(a, b)) + ")"


def ssub(a, b):
    return tuple(f"(({p}) - ({q}))" for p, q in zip(a, b))


def sadd(a, b):
    return tuple(f"(({p}) + ({q}))" for p, q in zip(a, b))


def smul(a, s):
    return tuple(f"(({p}) * ({s}))" for p in a)


def scross(a, b):
    return tuple(
        f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))
    )


def snorm(a) -> str:
    return f"sqrt({sdot(a, a)})"


def sunit(a):
    return tuple(f"(({p}) / CASE WHEN {snorm(a)} = 0 THEN 1 ELSE {snorm(a)} END)" for p in a)
