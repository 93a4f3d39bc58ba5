"""Order of paths and rings put together from pieces."""

import random

import pytest
from pyspark.sql import functions as F

from scanweave.operators import loops, sections as sec


def brute(links):
    follow, out = {a: b for a, b in links}, {}
    for a in follow:
        seen, node = [a], a
        while follow.get(node, a) != a:
            seen.append(node := follow[node])
        closed = follow.get(node) == a
        part = min(seen)
        if closed:
            out.update({v: (part, True, len(seen), (k - seen.index(part)) % len(seen)) for k, v in enumerate(seen)})
        elif a not in follow.values():
            out.update({v: (part, False, len(seen), k) for k, v in enumerate(seen)})
    return out


@pytest.mark.parametrize("chunk,spread", [(200_000, False), (7, False), (3, True)])
def test_ordered_puts_pieces_together(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(loops, "CHUNK_LINKS", chunk)
    rng = random.Random(3)
    names = rng.sample(range(-500, 500), 400)
    links, start = [], 0
    for size, closed in ((2, True), (2, False), (1, False), (3, True), (90, False), (120, True), (31, True), (64, False)):
        own = names[start:start + size]
        start += size
        links += [*zip(own, own[1:]), *([(own[-1], own[0])] if closed else [])]
    # In order of the paths, or dealt out by chance, where hardly any links are met together.
    rows = [(s, 4, a, b, rng.random() if spread else float(k)) for s in ("p", "q") for k, (a, b) in enumerate(links)]
    table = spark.createDataFrame(rows, "scan_id string, section_id int, a long, b long, near double").repartition(3)
    got = loops.ordered(table, ["scan_id", "section_id"]).collect()
    want = brute(links)
    assert len(got) == 2 * len(want)
    for scan in "pq":
        assert {r.a: (r.part, r.closed, r.n, r.pos) for r in got if r.scan_id == scan} == want


def test_no_links(spark):
    table = spark.createDataFrame([], "scan_id string, section_id int, a long, b long, near double")
    assert loops.ordered(table, ["scan_id", "section_id"]).count() == 0


def test_sections_do_not_rank_link_by_link(spark, monkeypatch):
    """Components and ranks moved every segment in every round; now a round moves the pieces left over."""
    n, states, counted = 600, [], loops.cut_counting
    monkeypatch.setattr(loops, "CHUNK_LINKS", 100)
    monkeypatch.setattr(loops, "cut_counting", lambda *a: states.append(counted(*a)) or states[-1])
    k = F.col("id")
    edge = lambda s, v: [v.alias(f"{s}lo"), (v + 10_000).alias(f"{s}hi"), v.cast("double").alias(f"{s}x"), F.lit(0.0).alias(f"{s}y"), F.lit(1.0).alias(f"{s}z")]
    segments = spark.range(n).select(F.lit("s").alias("scan_id"), F.lit(0).alias("section_id"), k.alias("face_id"), *edge("s", k), *edge("e", (k + 1) % n))
    open_one = segments.select(F.lit("t").alias("scan_id"), *segments.columns[1:]).filter(f"face_id < {n - 1}")
    alone = segments.filter("face_id = 5").withColumn("scan_id", F.lit("u"))
    chains, points = sec.chain_segments(segments.unionByName(open_one).unionByName(alone))
    assert sorted(tuple(r) for r in chains.collect()) == [("s", 0, 0, True, n), ("t", 0, 0, False, n), ("u", 0, 5, False, 2)]
    own = {(r.scan_id, r.pos): r.x for r in points.collect()}
    assert own == {("s", p): p for p in range(n)} | {("t", p): p for p in range(n)} | {("u", 0): 5, ("u", 1): 6}
    assert states and all(df.count() <= 60 for df, _ in states)
