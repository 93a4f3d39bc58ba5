"""Cases in which rows or ids were once lost."""

from pyspark.sql import functions as F


def test_far_neighbours_are_found(spark):
    from scanweave.operators.spatial import k_nearest

    queries = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0)], "scan_id string, q_id long, x double, y double, z double")
    targets = spark.createDataFrame([("s", i, 1e6 + i, 0.0, 0.0) for i in range(3)], "scan_id string, t_id long, x double, y double, z double")
    assert [r["t_id"] for r in k_nearest(queries, targets, 2, F.lit(500.0)).orderBy("rank").collect()] == [0, 1]


def test_wide_polygons_keep_their_ids_apart(spark):
    from scanweave.sources.intake import indexed_mesh

    schema = "scan_id string, item string, id long, x double, y double, z double, corners array<long>"
    rows = [("s", "vertex", i, float(i), 0.0, 0.0, None) for i in range(1_100)]
    rows += [("s", "face", 0, None, None, None, list(range(1_100))), ("s", "face", 1, None, None, None, [0, 1, 2])]
    _, faces, _ = indexed_mesh(spark.createDataFrame(rows, schema))
    assert faces.count() == 1_099 and faces.select("face_id").distinct().count() == 1_099


FACET = "facet normal 0 0 1\nouter loop\nvertex {0} 0 0\nvertex 1 0 0\nVertex 0 1 0\nendloop\nendfacet\n"


def read_text_scans(spark, folder, step):
    from scanweave.sources import stl

    stl.register(spark)
    rows = spark.read.format("scan_stl").option("bytesPerSplit", step).load(str(folder)).collect()
    return sorted((r["scan_id"], r["face_id"], r["ax"]) for r in rows)


def test_parts_of_an_ascii_scan_are_numbered_on(spark, tmp_path):
    for part, n in enumerate((3, 2, 2)):
        facets = "".join(FACET.format(10 * part + k) for k in range(n))
        (tmp_path / f"x.part-{part}.stl").write_text(f"solid x\n{facets}endsolid x\nsolid y\nendsolid y\n")
    whole = read_text_scans(spark, tmp_path, 1 << 20)
    assert [r[2] for r in whole] == [0.0, 1.0, 2.0, 10.0, 11.0, 20.0, 21.0]
    assert len({r[1] for r in whole}) == 7 and {r[0] for r in whole} == {"x"}
    # Byte ranges of any width, also narrower than a facet or a word, give the same rows.
    for step in (5, 37, 100, 101):
        assert read_text_scans(spark, tmp_path, step) == whole


def test_equal_names_in_two_folders_are_two_scans(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.stl").write_text("solid x\n" + FACET.format(1) + "endsolid x\n")
    assert [r[0] for r in read_text_scans(spark, tmp_path, 1 << 20)] == ["a/part", "b/part"]


def test_incomplete_facets_are_refused(tmp_path):
    import pytest
    from scanweave.sources.stl import StlReader

    whole = FACET.format(1)
    for broken in (whole[:-10], whole.replace("vertex 1 0 0\n", ""), whole + "facet normal 0 0 1\n"):
        (tmp_path / "x.stl").write_text("solid x\n" + broken)
        reader = StlReader({"path": str(tmp_path)})
        with pytest.raises(ValueError, match="incomplete facet"):
            [list(reader.read(split)) for split in reader.partitions()]


def test_short_rings_wrap_around_as_often_as_needed(spark):
    from scanweave.operators.polylines import windowed

    ring = spark.createDataFrame([("s", 1, p, float(p), 0.0) for p in range(3)], "scan_id string, chain_id long, pos long, u double, v double")
    total = {"total": lambda w: F.sum("u").over(w.rowsBetween(-4, 4)), "n": lambda w: F.count("*").over(w.rowsBetween(-4, 4))}
    got = {r["pos"]: (r["total"], r["n"]) for r in windowed(ring, 4, total, closed=True).collect()}
    assert got == {p: (float(sum((p + d) % 3 for d in range(-4, 5))), 9) for p in range(3)}


def test_a_mesh_can_be_filled_again(spark):
    from scanweave.operators.loops import fill_holes

    at = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    sides = [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
    vertices = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(at)], "scan_id string, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([("s", i, *f, False) for i, f in enumerate(sides)], "scan_id string, face_id long, v0 long, v1 long, v2 long, synthetic boolean")
    once = fill_holes(vertices, faces, 5.0)
    assert once.faces.count() == 16
    # One fan opens again at a vertex that was added, so a loop meets ids of the first filling.
    torn = once.faces.filter("face_id >= 0 OR face_id % 2 = 0")
    twice = fill_holes(once.vertices, torn, 50.0)
    for table, key in ((twice.vertices, "vertex_id"), (twice.faces, "face_id")):
        assert table.count() == table.select(key).distinct().count()


def test_every_large_plane_is_found(spark):
    from scanweave.operators.directions import detect_planes

    schema = "scan_id string, face_id long, area double, gx double, gy double, gz double, nx double, ny double, nz double"
    plates = [("s", 9 * p + k, 1.0, float(k % 3), float(k // 3), 10.0 * p, 0.0, 0.0, 1.0) for p in range(9) for k in range(9)]
    found = detect_planes(spark.createDataFrame(plates, schema), 0.3)
    assert sorted(round(r["pz"]) for r in found.collect()) == [10 * p for p in range(9)]
    assert detect_planes(spark.createDataFrame([], schema), 0.3).count() == 0
