"""Growth of many seeds side by side."""

from scanweave.operators import segmentation as seg
from scanweave.session import cut


def test_growth_writes_a_ring_once(spark, monkeypatch):
    """Every round wrote all faces found so far again."""
    faces = [("s", f, 0.0, 0.0, 1.0 if f != 30 else -1.0) for f in range(41)]
    normals = spark.createDataFrame(faces, "scan_id string, face_id long, nx double, ny double, nz double")
    pairs = spark.createDataFrame([("s", f, f + 1) for f in range(40)], "scan_id string, fa long, fb long")
    seeds = spark.createDataFrame([("s", 0), ("s", 25), ("s", 25)], "scan_id string, face_id long")
    written = []
    monkeypatch.setattr(seg, "cut", lambda df: written.append(out := cut(df)) or out)
    got = seg.grow_normal(seeds, pairs, normals, 10.0)
    assert sorted((r.seed, r.face_id) for r in got.collect()) == sorted([*[(s, f) for s in (0, 25) for f in range(30)], (25, 25)])
    rings = [df.count() for df in written if df.columns == ["scan_id", "seed", "face_id"]]
    assert sum(rings) == 61 and max(rings[1:]) <= 4
