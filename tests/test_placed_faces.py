"""Winding, parts and crease zones meet by the place of their faces, with the same result."""

import pytest
from pyspark.sql import functions as F

from scanweave.operators import graph, repair as ops, segmentation as seg
from scanweave.session import cut

WIDTH = 24


def sheet(spark):
    """A square of faces whose ids are shuffled, every 7th turned over, and a triangle of its own."""
    rows, at = [], lambda i, j: (i * (WIDTH + 1) + j) * 7_919 % 1_000_003
    for i in range(WIDTH):
        for j in range(WIDTH):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            rows += [("s", 2 * (i * WIDTH + j) * 104_729 % 1_000_003, a, b, c, False), ("s", (2 * (i * WIDTH + j) + 1) * 104_729 % 1_000_003, a, c, d, False)]
    rows = [(s, f, c, b, a, x) if f % 7 == 0 else (s, f, a, b, c, x) for s, f, a, b, c, x in rows]
    places = [("s", at(i, j), float(i), float(j), 0.0) for i in range(WIDTH + 1) for j in range(WIDTH + 1)]
    rows.append(("s", 2_000_000, 2_000_001, 2_000_002, 2_000_003, False))
    places += [("s", 2_000_000 + k, 90.0 + k, 90.0 + k * k, 0.0) for k in (1, 2, 3)]
    return (cut(spark.createDataFrame(places, "scan_id string, vertex_id long, x double, y double, z double")),
            cut(spark.createDataFrame(rows, "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean")))


@pytest.fixture
def given(monkeypatch):
    """What the rounds are given, with short chunks."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", 400)
    rounds, stars = [], graph.stars
    monkeypatch.setattr(graph, "stars", lambda links: rounds.append(kept := cut(links)) or stars(kept))
    return rounds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_places_keep_every_face(spark):
    vertices, faces = sheet(spark)
    odd = faces.unionByName(spark.createDataFrame([("s", -1, None, 5, 6, False), (None, -2, 1, 2, 3, False)], faces.schema))
    placed = ops.placed_faces(vertices.unionByName(vertices.limit(40)), odd)
    assert rows(placed.select("face_id")) == rows(odd.select("face_id"))
    assert rows(placed.filter("near IS NULL").select("face_id")) == [(-2,), (-1,)]


def test_vertex_parts_by_place(spark, given):
    vertices, faces = sheet(spark)
    want = rows(graph.vertex_parts(faces).select("face_id", "part"))
    given.clear()
    placed = cut(ops.placed_faces(vertices, faces))
    assert rows(graph.vertex_parts(placed).select("face_id", "part")) == want
    assert given[0].count() < 700  # of 2,304 links
    assert ops.without_small_parts(placed).count() == len(want) - 1


def test_crease_zone_by_place(spark, given):
    vertices, faces = sheet(spark)
    residual = vertices.select("scan_id", "vertex_id", F.when(F.col("x") < 12, F.col("y") + 1.0).otherwise(0.1).alias("residual"))
    area = faces.select("scan_id", "face_id", F.lit(0.3).alias("area"))
    want = rows(seg.crease_zone(faces, residual, area))
    given.clear()
    assert want and rows(seg.crease_zone(cut(ops.placed_faces(vertices, faces)), residual, area)) == want
    assert given[0].count() < 400
