"""Broadcast sizes, dealing and block searches: the same rows without plans that outgrow a machine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scanweave.operators import noise, planar, selection as sel, spatial as sp
from scanweave.operators.entities import measurement_sigma
from scanweave.registry import QUERIES, load_all
from scanweave.session import dealt, few, prepare, prepare_scans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def scans(spark):
    yield prepare_scans(spark)
    prepare(spark)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_rows_an_explode_adds_are_not_broadcast(scans):
    points = scans.createDataFrame([("s", 1, 5.0, 5.0), ("s", 2, 50.0, 50.0)], "scan_id string, face_id long, px double, py double")
    square = [("s", 7, 0.0, 0.0, 9.0, 0.0), ("s", 7, 9.0, 0.0, 9.0, 9.0), ("s", 7, 9.0, 9.0, 0.0, 9.0), ("s", 7, 0.0, 9.0, 0.0, 0.0)]
    edges = scans.createDataFrame(square, "scan_id string, polygon_id long, x0 double, y0 double, x1 double, y1 double")
    inside = sel.in_polygons(points, edges)
    assert "BroadcastHashJoin" not in plan(inside)
    assert [(r.polygon_id, r.face_id) for r in inside.collect()] == [(7, 1)]
    flat = points.select("scan_id", F.col("face_id").alias("point_id"), F.col("px").alias("u"), F.col("py").alias("v"))
    found = planar.points_in_polygons(flat, edges, 4.0)
    assert "BroadcastHashJoin" not in plan(found)
    assert [(r.polygon_id, r.point_id) for r in found.collect()] == [(7, 1)]


def test_draws_are_not_broadcast(scans):
    item = lambda n: ("s", n, "axis", 2.0, float(n), 0.0, 0.0, 0.0, 0.0, 1.0, 0.001, 0.01, 0.01)
    items = scans.createDataFrame([item(n) for n in (1, 2)], "scan_id string, item_id int, item string, diameter double, ox double, oy double, oz double, "
                                  "nx double, ny double, nz double, tilt_sigma double, shift_sigma double, size_sigma double")
    pairs = scans.createDataFrame([("s", 1, 2)], "scan_id string, a int, b int")
    out = measurement_sigma(items, pairs)
    shaken = [line for line in plan(out).splitlines() if "BroadcastHashJoin" in line and "draw" in line]
    assert not shaken and 0 < out.collect()[0].distance_sigma < 0.1


@pytest.mark.parametrize("name", ["x08_affected", "a05_closed_report"])
def test_only_small_files_are_broadcast_before_sizes_are_known(spark, name):
    if not QUERIES:
        load_all()
    QUERIES[name](spark, SF)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "64KB"
    prepare(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10MB"


def test_few_and_dealt(spark):
    rows = spark.range(100)
    assert "ResolvedHint" in few(rows)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in few(rows, 99)._jdf.queryExecution().analyzed().toString()
    assert dealt(rows, "id", rows=10).rdd.getNumPartitions() == 10


def cloud(n, seed, width):
    draw = random.Random(seed)
    return [("s", k, draw.random() * width[0], draw.random() * width[1], draw.random() * width[2]) for k in range(n)]


@pytest.mark.parametrize("width", [(100.0, 1.0, 0.0), (1.0, 1.0, 1.0), (50.0, 0.0, 0.0)])
def test_nearest_in_long_and_flat_boxes(spark, width):
    targets, queries = cloud(400, 1, width), cloud(60, 2, width) + [("s", 900, -30.0, 2.0, 5.0)]
    schema = "scan_id string, {} long, x double, y double, z double"
    got = sp.nearest(spark.createDataFrame(queries, schema.format("q_id")), spark.createDataFrame(targets, schema.format("t_id")))
    want = {q[1]: min((math.dist(q[2:], t[2:]), t[1]) for t in targets) for q in queries}
    assert {r.q_id: r.t_id for r in got.collect()} == {q: t for q, (_, t) in want.items()}


def test_long_box_is_not_crowded(spark, monkeypatch):
    """A strip of 400 x 1 held over 64 rows a cell, so that every query walked down the tree."""
    monkeypatch.setattr(sp, "_descend", lambda *_: pytest.fail("no query should need the tree"))
    strip = [("s", k, k / 5 % 400.0, k % 5 / 5.0, 0.0) for k in range(2000)]
    schema = "scan_id string, {} long, x double, y double, z double"
    sp.nearest(spark.createDataFrame(strip, schema.format("q_id")), spark.createDataFrame(strip, schema.format("t_id"))).collect()


def test_local_fits_equal_a_plain_fit(spark):
    draw = random.Random(5)
    rows = [("s", 20 * i + j, float(i), float(j), 0.02 * i * i + draw.random() / 100, 0.0, 0.0, 1.0) for i in range(12) for j in range(12)]
    points = spark.createDataFrame(rows, "scan_id string, vertex_id long, x double, y double, z double, nx double, ny double, nz double")
    fits = {r.q_id: r for r in noise._local_fits(points, 1.0, 9).collect()}
    assert len(fits) == len(rows) and all(r.n == 9 for r in fits.values())
    import numpy as np

    by = {r[1]: np.array(r[2:5]) for r in rows}
    for q in (0, 20 * 5 + 6):
        near = sorted(by, key=lambda t: (math.dist(by[q], by[t]), t))[:9]
        d = np.array([by[t] - by[q] for t in near])
        f = fits[q]
        u, v = d @ [f.ex, f.ey, f.ez], d @ [f.gx, f.gy, f.gz]
        a = np.column_stack([u * u / 2, u * v, v * v / 2, u, v, np.ones(9)])
        left = d[:, 2] - a @ np.linalg.lstsq(a, d[:, 2], rcond=None)[0]
        assert f.residual == pytest.approx(math.sqrt((left ** 2).mean()), abs=1e-5)


def test_deviation_map_broadcasts_no_table_that_grows(spark):
    """Nominal triangles, their normals and measured vertices compress well in a shuffle, so they looked small enough for the driver."""
    from scanweave.operators import deviation_stats as ds, mesh, spatial

    k = F.col("id")
    corner = F.struct(k.alias("vertex_id"), (k % 20).cast("double").alias("x"), F.floor(k / 20).cast("double").alias("y"), F.lit(0.0).alias("z"))
    vertices = spark.range(400).select(F.lit("scan_0").alias("scan_id"), corner.alias("c")).select("scan_id", "c.*")
    faces = spark.range(380).filter("id % 20 < 19").select(
        F.lit("scan_0").alias("scan_id"), k.alias("face_id"), k.alias("v0"), (k + 1).alias("v1"), (k + 20).alias("v2"))
    tri = mesh.face_geometry(mesh.corners(vertices, faces))
    assert tri.count() == 361
    normals = spatial.feature_normals(faces, tri)
    assert normals.count() == 361 * 7
    hits = spatial.signed_distances(vertices.withColumn("z", F.col("z") + 0.25), tri.withColumn("tri_id", F.col("face_id")), normals, 0.5)
    means = ds.face_means(hits.select("scan_id", "vertex_id", "signed"), faces)
    for made in (tri, normals, hits, means):
        rows = made.collect()
        assert rows and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert {round(abs(r["value"]), 6) for r in rows} == {0.25}
