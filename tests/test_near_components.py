"""Components of edges dealt by their place, and the repair built on them."""

import random

import pytest
from pyspark.sql import functions as F

from scanweave.operators import graph, mesh, repair as ops
from scanweave.plans.repair import repair
from scanweave.session import cut

WIDTH = 24


def brute(links):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root if find(v) != v}


@pytest.mark.parametrize("spread", [False, True])
def test_stars_near_finds_every_component(spark, monkeypatch, spread):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 20)
    rng = random.Random(5)
    ids = rng.sample(range(-1_000, 1_000), 300)
    links = [(ids[k], ids[k + 1]) for k in range(200) if k % 50] + [(ids[210], v) for v in ids[211:290]] + [(ids[0], ids[210])]
    rows = [(s, a, b, rng.randrange(1_000) if spread else k) for s in ("p", "q") for k, (a, b) in enumerate(links)]
    table = spark.createDataFrame(rows, "scan_id string, a long, b long, near long").repartition(3)
    got = graph.stars_near(graph.near_by(table, "near")).collect()
    want = brute(links)
    assert len(got) == 2 * len(want)
    for scan in "pq":
        assert {r.a: r.b for r in got if r.scan_id == scan} == want


def sheet(spark, z=lambda i, j: 0.0):
    """A grid whose faces are numbered by chance; every 7th is turned over."""
    ids = list(range(2 * WIDTH * WIDTH))
    random.Random(2).shuffle(ids)
    at = lambda i, j: i * (WIDTH + 1) + j
    cells = [(i, j) for i in range(WIDTH) for j in range(WIDTH)]
    rows = [t for i, j in cells for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    faces = [("s", f, *(r if f % 7 else r[::-1]), False) for f, r in zip(ids, rows)]
    points = [("s", at(i, j), float(i), float(j), z(i, j)) for i in range(WIDTH + 1) for j in range(WIDTH + 1)]
    return (spark.createDataFrame(points, "scan_id string, vertex_id long, x double, y double, z double"),
            spark.createDataFrame(faces, "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean"))


def test_repair_rounds_move_border_faces_only(spark, monkeypatch):
    """Every round of the winding's components moved both sides of every face."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", 400)
    given, stars = [], graph.stars
    monkeypatch.setattr(graph, "stars", lambda links: given.append(kept := cut(links)) or stars(kept))
    monkeypatch.setattr(ops, "stars", graph.stars)
    vertices, faces = sheet(spark)
    fixed = repair(vertices, faces)
    turned = ops.winding(faces, mesh.face_pairs(faces)).collect()
    assert {r.face_id for r in turned if r.flip} == {f for f in range(2 * WIDTH * WIDTH) if f % 7 == 0}
    up = mesh.corners(vertices, fixed.faces).select("face_id", mesh.face_cross().z.alias("k")).collect()
    assert len(up) == 2 * WIDTH * WIDTH and len({r.k for r in up}) == 1
    assert fixed.counts.first().flipped_faces == len([f for f in range(2 * WIDTH * WIDTH) if f % 7 == 0])
    assert sorted(fixed.faces.columns) == sorted(faces.columns)
    # 576 x 2 faces have 1,680 pairs, 3,360 links of the double cover.
    assert given[0].count() < 700


def test_marks_of_odd_coordinates(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(0, 0.0, 0.0, 0.0), (1, inf, 1.0, 0.0), (2, nan, 0.0, 1.0), (3, -inf, 2.0, 2.0), (4, None, 3.0, 3.0), (5, 1.0, 1.0, 1.0)]
    vertices = spark.createDataFrame([("s", *r) for r in odd], "scan_id string, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([("s", 0, 0, 1, 2, False), ("s", 1, 0, 3, 5, False), ("s", 2, 4, 5, 0, False), ("s", 3, 5, 5, 0, False), ("s", 4, 5, 9, 0, False)],
                                  "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean")
    steps = ("degenerate", "duplicates")
    fixed = repair(vertices, faces, steps)
    assert sorted(fixed.faces.columns) == sorted(faces.columns)
    assert 4 in {r.face_id for r in fixed.faces.collect()} and 3 not in {r.face_id for r in fixed.faces.collect()}
