"""Known shapes, brute force and invariants."""

import math
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanweave.operators import graph, loops, mesh, spatial
from scanweave.operators.quantiles import exact_percentiles
from scanweave.plans import fits
from scanweave.sources import intake, stl


def test_percentiles_of_a_large_group_are_exact(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=40_000) ** 3, 3)
    values[:15_000] = 0.25  # one value holds a third of the group
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values})).repartition(16)
    row = exact_percentiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}).first()
    want = np.percentile(values, [1, 50, 99, 0, 100])
    assert np.allclose([row.p1, row.p50, row.p99, row.p0, row.p100], want, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 13])
def test_components_of_long_and_starry_graphs(spark, parts):
    rng = np.random.default_rng(3)
    chain = [("s", int(a), int(a) + 1) for a in range(1000, 1400)]
    star = [("s", 5, int(b)) for b in range(2000, 2600)]
    other = [("t", 5, 1000)]
    edges = chain + star + other
    order = rng.permutation(len(edges))
    links = spark.createDataFrame([edges[k] for k in order], "scan_id string, a long, b long").repartition(parts)
    nodes = links.select("scan_id", F.col("a").alias("n")).union(links.select("scan_id", F.col("b").alias("n"))).distinct()
    found = {(r.scan_id, r.n): r.part for r in graph.components(nodes, links, node="n").collect()}
    assert {found["s", n] for n in range(1000, 1401)} == {1000}
    assert {found["s", n] for n in [5, *range(2000, 2600)]} == {5}
    assert found["t", 1000] == 5


def test_nearest_with_crowded_and_far_points(spark):
    rng = np.random.default_rng(11)
    crowd = rng.normal(scale=1e-4, size=(3000, 3)) + [5, 5, 5]
    spread = rng.uniform(0, 100, size=(800, 3))
    copies = np.repeat([[50.0, 50, 50]], 400, axis=0)
    targets = np.vstack([crowd, spread, copies])
    queries = np.vstack([rng.uniform(-300, 400, size=(60, 3)), crowd[:40] + 5e-5, [[50, 50, 50.0]]])
    frame = lambda p, n: spark.createDataFrame(pd.DataFrame({"scan_id": "a", n: np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    found = {r.q_id: (r.t_id, r.dist) for r in spatial.nearest(frame(queries, "q_id"), frame(targets, "t_id")).collect()}
    gap = np.linalg.norm(queries[:, None] - targets[None], axis=2)
    assert len(found) == len(queries)
    for k, row in enumerate(gap):
        assert math.isclose(found[k][1], row.min(), rel_tol=1e-9, abs_tol=1e-12)
        assert found[k][0] == int(np.argmin(row))


def test_closest_points_against_brute_force(spark):
    rng = np.random.default_rng(5)
    tri = rng.uniform(0, 10, size=(120, 3, 3))
    tri[:40] = tri[:40, :1] + rng.normal(scale=0.3, size=(40, 3, 3))  # small ones beside large ones
    pts = rng.uniform(-1, 11, size=(300, 3))
    t = pd.DataFrame(tri.reshape(-1, 9), columns=[f"{c}{a}" for c in "abc" for a in "xyz"]).assign(scan_id="a", tri_id=np.arange(120))
    p = pd.DataFrame(pts, columns=list("xyz")).assign(scan_id="a", vertex_id=np.arange(300))
    hits = spatial.closest_points(spark.createDataFrame(p), spark.createDataFrame(t), 1.3).toPandas().set_index("vertex_id")
    # Dense barycentric samples bound the true distance from above.
    u = np.linspace(0, 1, 60)
    bary = np.array([(a, b, 1 - a - b) for a in u for b in u if a + b <= 1 + 1e-9])
    for k, point in enumerate(pts):
        near = min(np.linalg.norm(bary @ corners - point, axis=1).min() for corners in tri)
        if k in hits.index:
            assert hits.dist[k] <= near + 1e-9 and hits.dist[k] >= near - 0.3
        else:
            assert near > 1.3 - 1e-9


def test_fits_recover_a_tilted_cylinder(spark):
    rng = np.random.default_rng(2)
    axis = np.array([0.3, -0.5, 0.8]) / np.linalg.norm([0.3, -0.5, 0.8])
    e = np.cross(axis, [1.0, 0, 0])
    e /= np.linalg.norm(e)
    g = np.cross(axis, e)
    a, h = rng.uniform(0, 4, 4000), rng.uniform(-8, 8, 4000)
    n = np.cos(a)[:, None] * e + np.sin(a)[:, None] * g
    p = [3, 4, 5] + (10 + rng.normal(scale=0.03, size=4000))[:, None] * n + h[:, None] * axis
    rows = pd.DataFrame(np.hstack([p, n]), columns=["x", "y", "z", "nx", "ny", "nz"]).assign(scan_id="a", label=1, point_id=np.arange(4000))
    df = spark.createDataFrame(rows).withColumn("label", F.col("label").cast("int"))
    best = fits.fit_best(df, 0.03).first()
    assert best.kind == "cylinder" and abs(best.radius - 10) < 0.005 and abs(best.rms - 0.03) < 0.003
    assert abs(abs(np.dot([best.nx, best.ny, best.nz], axis)) - 1) < 1e-5


def grid(n):
    v = [("a", j * (n + 1) + i, float(i), float(j), 0.0) for j in range(n + 1) for i in range(n + 1)]
    f, at = [], lambda i, j: j * (n + 1) + i
    for j in range(n):
        for i in range(n):
            if (i, j) == (n // 2, n // 2):
                continue  # a hole of one square
            f += [("a", 2 * at(i, j), at(i, j), at(i + 1, j), at(i + 1, j + 1), False), ("a", 2 * at(i, j) + 1, at(i, j), at(i + 1, j + 1), at(i, j + 1), False)]
    return v, f


def test_hole_is_filled_and_the_rim_stays(spark):
    v, f = grid(6)
    vertices = spark.createDataFrame(v, "scan_id string, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame(f, "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean")
    filled = loops.fill_holes(vertices, faces, 5.0)
    sizes = sorted((r.edges, r.filled) for r in filled.loops.collect())
    assert sizes == [(4, True), (24, False)]
    counts = mesh.edge_counts(filled.faces).first()
    assert (counts.boundary_edges, counts.non_manifold_edges, counts.inconsistent_edges) == (24, 0, 0)
    centre = filled.vertices.filter("vertex_id < 0").first()
    assert np.allclose([centre.x, centre.y, centre.z], [3.5, 3.5, 0.0], atol=1e-6)


def test_text_and_ply_files(spark, tmp_path):
    (tmp_path / "part.obj").write_text("# c\nv 0 0 0 1 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\nf 1 2 9\n")
    header = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(header.format("ascii 1.0") + "0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    body = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<B3i", 3, 0, 1, 2)
    (tmp_path / "b.ply").write_bytes(header.format("binary_little_endian 1.0").encode() + body)
    stl.register(spark)
    vertices, faces, bad = intake.indexed_mesh(spark.read.format("scan_obj").load(str(tmp_path)))
    assert vertices.count() == 4 and bad.count() == 1
    assert sorted((r.v0, r.v1, r.v2) for r in faces.collect()) == [(0, 1, 2), (0, 1, 2), (0, 2, 3)]
    vertices, faces, bad = intake.indexed_mesh(spark.read.format("scan_ply").load(str(tmp_path)))
    assert {(r.scan_id, r.v0, r.v1, r.v2) for r in faces.collect()} == {("a", 0, 1, 2), ("b", 0, 1, 2)}
    assert vertices.filter("scan_id = 'b' AND vertex_id = 1").first().x == 1.0


def test_stl_kinds(tmp_path):
    good = tmp_path / "good.stl"
    good.write_bytes(b"solid but binary".ljust(80, b"\0") + struct.pack("<I", 1) + b"\0" * 50)
    assert stl.stl_kind(str(good)) == ("binary", 1)
    text = tmp_path / "text.stl"
    text.write_text("solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid\n")
    assert stl.stl_kind(str(text))[0] == "ascii"
    broken = tmp_path / "broken.stl"
    broken.write_bytes(b"\1" * 84)
    with pytest.raises(ValueError):
        stl.stl_kind(str(broken))


def test_rounded_edge_radius(spark):
    from scanweave.operators.directions import edge_radii
    from scanweave.operators.patterns import section_radii

    rng = np.random.default_rng(9)
    radius, rows = 1.5, []
    for z in np.arange(0, 10, 0.05):
        for s in np.arange(radius, 5, 0.2):
            rows += [(s, 0.0, z), (0.0, s, z)]
        for a in np.linspace(0, math.pi / 2, 12):
            rows.append((radius - radius * math.cos(a), radius - radius * math.sin(a), z))
    p = np.array(rows) + rng.normal(scale=0.01, size=(len(rows), 3))
    points = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan_id="a", point_id=np.arange(len(p))))
    frames = spark.createDataFrame(pd.DataFrame([
        dict(scan_id="a", frame_id=k, edge_id=0, px=0.0, py=0.0, pz=1.0 + k, tx=0.0, ty=0.0, tz=1.0, ax=1.0, ay=0.0, az=0.0, bx=0.0, by=1.0, bz=0.0)
        for k in range(8)]))
    found = section_radii(points, frames, 0.01)
    edge = edge_radii(found, ["scan_id", "edge_id"], F.lit(8), 0.01).first()
    assert edge.samples == 8 and abs(edge.radius - radius) < 0.05 and edge.rms < 0.03
