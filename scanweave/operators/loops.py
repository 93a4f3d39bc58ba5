"""Boundary loops, chains, hole filling, smoothing, fans and profile checks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, frame_from_axis, stage, vec
from scanweave.operators import mesh
from scanweave.operators.graph import components, stars
from scanweave.session import cut, cut_counting, few

# Fixed values.
TAUBIN_LAMBDA, TAUBIN_MU = 0.5, -0.53
CHUNK_LINKS = 200_000
MAX_ROUNDS = 64


def taubin(vertices: DataFrame, faces: DataFrame, rounds: int) -> DataFrame:
    """Shrink-and-inflate smoothing; every vertex moves towards the mean of its neighbours."""
    links = cut(mesh.vertex_links(faces))
    for _ in range(rounds):
        for factor in (TAUBIN_LAMBDA, TAUBIN_MU):
            other = vertices.select("scan_id", F.col("vertex_id").alias("other"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
            means = links.join(other, ["scan_id", "other"]).groupBy("scan_id", "vertex_id").agg(*[F.avg(f"_{c}").alias(f"_m{c}") for c in "xyz"])
            moved = vertices.join(means, ["scan_id", "vertex_id"], "left").select(
                "scan_id", "vertex_id", *[(F.col(c) + factor * (F.coalesce(f"_m{c}", F.lit(0.0)) - F.col(c))).alias(c) for c in "xyz"])
            vertices = cut(moved)
    return vertices


def ranked(links: DataFrame, node: str = "a") -> DataFrame:
    """Distance of every node to the end of its chain, by pointer doubling.

    `links(scan_id, a, b)`: b follows a, NULL at the end. Each round doubles the step, so a
    chain of n nodes takes log2(n) joins.
    """
    state = cut(links.select("scan_id", "a", F.col("b").alias("_to"), F.when(F.col("b").isNull(), 0).otherwise(1).cast("long").alias("_steps")))
    for _ in range(64):
        if state.filter("_to IS NOT NULL").isEmpty():
            break
        ahead = state.select("scan_id", F.col("a").alias("_to"), F.col("_to").alias("_next"), F.col("_steps").alias("_more"))
        state = cut(state.join(ahead, ["scan_id", "_to"], "left").select(
            "scan_id", "a", F.col("_next").alias("_to"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps")))
    return state.select("scan_id", "a", F.col("_steps").alias("to_end"))


def _to_head(prev: np.ndarray, head: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head of every node's path, steps from it, and on rings the smallest name, by doubling backwards.

    A node whose stretch has the same smallest name as the stretch before it has gone round a ring.
    """
    to, steps, low = prev.copy(), np.where(head, 0, 1), name.copy()
    while True:
        open_ = np.flatnonzero(~head[to] & (low != low[to]))
        if not len(open_):
            return to, steps, low
        via = to[open_]
        to[open_], steps[open_], low[open_] = to[via], steps[open_] + steps[via], np.minimum(low[open_], low[via])


def _pieces(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Links of one chunk with the piece of a path they make there, or the ring they close there.

    A piece runs from `head` over `w` links to `b`; `low` is its smallest node before `b`, `off` steps from its head.
    """
    group = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    ids, rank = np.unique(np.r_[frame["a"].to_numpy(), frame["b"].to_numpy()], return_inverse=True)
    nodes, index = np.unique((np.r_[group, group].astype(np.int64) << 32) | rank, return_inverse=True)
    name = ids[nodes & 0xFFFFFFFF]
    left, right = index[: len(frame)], index[len(frame):]
    prev = np.arange(len(nodes))
    prev[right] = left
    head = prev == np.arange(len(nodes))
    to, steps, low = _to_head(prev, head, name)
    ring = ~head[to]
    if ring.any():  # a ring starts at its smallest node
        first = ring & (name == low)
        prev[first] = np.flatnonzero(first)
        to, steps, _ = _to_head(prev, head | first, name)
    at, own = steps[left], to[left]
    w = np.bincount(own, minlength=len(nodes))
    smallest, off, tail = np.full(len(nodes), np.iinfo(np.int64).max), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    np.minimum.at(smallest, own, name[left])
    best, last = name[left] == smallest[own], at == w[own] - 1
    off[own[best]] = at[best]
    tail[own[last]] = name[right[last]]
    return frame[[*keys, "a"]].assign(
        head=name[own], at=at, ring=ring[left], w=w[own], b=tail[own], low=smallest[own], off=off[own])


def ordered(links: DataFrame, keys: list[str]) -> DataFrame:
    """Order of paths and rings: `(*keys, a, part, closed, n, pos)` for every linked node.

    `links(*keys, a, b, near)`: b follows a; no node has two followers or follows two. `part` is
    the smallest node, a ring counts from it. Links close to each other by `near` meet in chunks
    and shrink to pieces of paths there; pieces are put together by pointer doubling, so a round
    moves one row per piece. `near` decides how many pieces are left, never the result.
    """
    links = cut(links)
    parts = max(1, -(-links.count() // CHUNK_LINKS))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            # A range is about one chunk; a larger one is dealt with in chunks.
            if rows >= 2 * CHUNK_LINKS:
                yield _pieces(pd.concat(held, ignore_index=True), keys)
                held, rows = [], 0
        if rows:
            yield _pieces(pd.concat(held, ignore_index=True), keys)

    types = ", ".join(f"{k} {links.schema[k].dataType.simpleString()}" for k in keys)
    rows = cut(links.repartitionByRange(parts, *keys, "near").mapInPandas(
        shrink, f"{types}, a long, head long, at long, ring boolean, w long, b long, low long, off long"))
    state, left = cut_counting(rows.filter("at = 0 AND NOT ring").select(
        *keys, F.col("head"), "w", F.col("b").alias("_to"), F.col("w").alias("_steps"), "low", "off", F.lit(None).cast("boolean").alias("closed")), F.lit(True))
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        ahead = state.select(*keys, F.col("head").alias("_to"), F.lit(True).alias("_met"), *[
            F.col(c).alias(f"_next{c}") for c in ("_to", "_steps", "low", "off", "closed")])
        moved = F.col("closed").isNull() & F.col("_met").isNotNull()
        round_ = moved & (F.col("low") == F.col("_nextlow"))
        on = moved & ~round_
        lower = on & (F.col("_nextlow") < F.col("low"))
        pick = lambda when, value, c: F.when(when, value).otherwise(F.col(c)).alias(c)
        state, left = cut_counting(state.join(ahead, [*keys, "_to"], "left").select(
            *keys, "head", "w", pick(on, F.col("_next_to"), "_to"), pick(on, F.col("_steps") + F.col("_next_steps"), "_steps"),
            pick(lower, F.col("_nextlow"), "low"), pick(lower, F.col("_steps") + F.col("_nextoff"), "off"),
            F.when(F.col("closed").isNotNull(), F.col("closed")).when(F.col("_met").isNull(), False).when(round_, True).otherwise(F.col("_nextclosed")).alias("closed"),
        ), F.col("closed").isNull())
    paths = cut(state.filter("NOT closed").groupBy(*keys, "_to").agg(F.max("_steps").alias("_links"), F.min("low").alias("_low")).select(
        *keys, "_to", F.least("_low", "_to").alias("part"), (F.col("_links") + 1).alias("n")))
    rings = state.filter("closed").groupBy(*keys, "low").agg(F.sum("w").alias("n"))
    solved = state.filter("NOT closed").join(paths, [*keys, "_to"]).select(
        *keys, "head", "part", "closed", "n", (F.col("n") - 1 - F.col("_steps")).alias("_shift")
    ).unionByName(state.filter("closed").join(rings, [*keys, "low"]).select(
        *keys, "head", F.col("low").alias("part"), "closed", "n", (-F.col("off")).alias("_shift")))
    inner = rows.filter("NOT ring").join(few(solved), [*keys, "head"]).select(
        *keys, "a", "part", "closed", "n", F.pmod(F.col("at") + F.col("_shift"), "n").alias("pos"))
    whole = rows.filter("ring").select(*keys, "a", F.col("head").alias("part"), F.lit(True).alias("closed"), F.col("w").alias("n"), F.col("at").alias("pos"))
    ends = paths.select(*keys, F.col("_to").alias("a"), "part", F.lit(False).alias("closed"), "n", (F.col("n") - 1).alias("pos"))
    return inner.unionByName(whole).unionByName(ends)


def closed_loops(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered loops `(scan_id, loop_id, pos, vertex_id)` of directed arcs `(scan_id, src, dst)`,
    and the ids of loops that were skipped because they pass a vertex twice or stay open.

    The loop is opened at its smallest vertex; positions count from there.
    """
    arcs = cut(arcs.select("scan_id", "src", "dst"))
    links = arcs.select("scan_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = arcs.select("scan_id", F.explode(F.array("src", "dst")).alias("vertex_id")).distinct()
    parts = cut(components(nodes, links, node="vertex_id"))
    ends = F.array(F.struct(F.col("src").alias("vertex_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                   F.struct(F.col("dst").alias("vertex_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = arcs.select("scan_id", F.inline(ends)).groupBy("scan_id", "vertex_id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    skipped = cut(degree.filter("o <> 1 OR i <> 1").join(parts, ["scan_id", "vertex_id"]).select("scan_id", F.col("part").alias("loop_id")).distinct())
    simple = arcs.join(parts.withColumnRenamed("vertex_id", "src"), ["scan_id", "src"]).join(
        skipped.withColumnRenamed("loop_id", "part"), ["scan_id", "part"], "left_anti")
    opened = cut(simple.select("scan_id", "part", F.col("src").alias("a"), F.when(F.col("dst") != F.col("part"), F.col("dst")).alias("b")))
    rank = ranked(opened).join(opened.select("scan_id", "a", "part"), ["scan_id", "a"])
    length = opened.groupBy("scan_id", "part").agg(F.count("*").alias("_n"))
    loops = rank.join(length, ["scan_id", "part"]).select(
        "scan_id", F.col("part").alias("loop_id"), (F.col("_n") - 1 - F.col("to_end")).alias("pos"), F.col("a").alias("vertex_id"))
    return loops, skipped


def boundary_loops(faces: DataFrame) -> DataFrame:
    """Ordered boundary loops of a mesh."""
    return closed_loops(mesh.boundary(faces))[0]


class Filled(NamedTuple):
    vertices: DataFrame
    faces: DataFrame
    loops: DataFrame


def fill_holes(vertices: DataFrame, faces: DataFrame, max_perimeter: float) -> Filled:
    """Close loops up to a perimeter by a fan around one new vertex on a local quadric.

    The quadric is fitted to all vertices of the faces around the loop; where it is not
    determined (fewer than 12 points) or lifts by more than half the mean radius, the new
    vertex stays at the centroid. `loops` lists every loop with its size and whether it was filled.
    """
    order = cut(boundary_loops(faces))
    at = vertices.select("scan_id", "vertex_id", "x", "y", "z")
    rim = order.join(at, ["scan_id", "vertex_id"])
    nxt = order.select("scan_id", "loop_id", (F.col("pos") - 1).alias("pos"), F.col("vertex_id").alias("_n"))
    first = order.filter("pos = 0").select("scan_id", "loop_id", F.col("vertex_id").alias("_f"))
    rim = rim.join(nxt, ["scan_id", "loop_id", "pos"], "left").join(first, ["scan_id", "loop_id"]).withColumn("next_id", F.coalesce("_n", "_f")).drop("_n", "_f")
    rim = cut(rim.join(at.select("scan_id", F.col("vertex_id").alias("next_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"]), ["scan_id", "next_id"]))
    step = (vec("n") - vec()).norm()
    loops = cut(rim.groupBy("scan_id", "loop_id").agg(
        F.count("*").alias("edges"), F.sum(step).alias("perimeter"), *[F.avg(c).alias(f"c{c}") for c in "xyz"],
    ).withColumn("filled", F.col("perimeter") <= max_perimeter))
    chosen = loops.filter("filled")
    members = rim.join(chosen.select("scan_id", "loop_id"), ["scan_id", "loop_id"], "left_semi").select("scan_id", "loop_id", "vertex_id")
    corner = faces.select("scan_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    touching = corner.join(members, ["scan_id", "vertex_id"]).select("scan_id", "loop_id", "face_id").distinct()
    ring = cut(touching.join(faces.select("scan_id", "face_id", "v0", "v1", "v2"), ["scan_id", "face_id"]))
    tri = mesh.corners(vertices, ring.select("scan_id", "face_id", "v0", "v1", "v2").distinct(), carry=[])
    k = mesh.face_cross()
    normal = ring.join(tri, ["scan_id", "face_id"]).groupBy("scan_id", "loop_id").agg(*[F.sum(c).alias(f"k{n}") for n, c in zip("xyz", k)])
    frame = chosen.join(normal, ["scan_id", "loop_id"])
    frame = stage(frame, m=vec("k").unit())
    e1, e2 = frame_from_axis(vec("m"))
    frame = cut(stage(frame, e=e1, g=e2))
    around = ring.select("scan_id", "loop_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct().join(at, ["scan_id", "vertex_id"])
    d = vec() - vec("c")
    local = around.join(frame, ["scan_id", "loop_id"]).select("scan_id", "loop_id", d.dot(vec("e")).alias("x"), d.dot(vec("g")).alias("y"), d.dot(vec("m")).alias("z"))
    from scanweave.operators.fitting import quadric_fit, quadric_sums

    lift = quadric_fit(local.groupBy("scan_id", "loop_id").agg(*quadric_sums()), ["scan_id", "loop_id"]).select("scan_id", "loop_id", "f", "n")
    radius = rim.join(chosen.select("scan_id", "loop_id", "cx", "cy", "cz"), ["scan_id", "loop_id"]).groupBy("scan_id", "loop_id").agg(
        F.avg((vec() - vec("c")).norm()).alias("radius"))
    centre = frame.join(lift, ["scan_id", "loop_id"], "left").join(radius, ["scan_id", "loop_id"])
    usable = (F.col("n") >= 12) & F.col("f").isNotNull() & (F.abs("f") <= 0.5 * F.col("radius"))
    by = F.when(usable, F.col("f")).otherwise(0.0)
    # New ids follow from the loop and its vertices, below every id in use: unique when a filled mesh is filled again.
    lowest = lambda df, c: df.groupBy("scan_id").agg(F.least(F.min(c), F.lit(0)).alias(f"_low_{c}"))
    base = cut(lowest(at, "vertex_id").join(lowest(faces, "face_id"), "scan_id"))
    new_id = 2 * F.col("_low_vertex_id") - 1 - F.col("loop_id")
    added = centre.join(base, "scan_id").select("scan_id", new_id.alias("vertex_id"), *(vec("c") + vec("m") * by).named())
    new_face = F.col("_low_face_id") + F.col("_low_vertex_id") - 1 - F.col("vertex_id")
    fan = rim.join(chosen.select("scan_id", "loop_id"), ["scan_id", "loop_id"], "left_semi").join(base, "scan_id").select(
        "scan_id", new_face.alias("face_id"), F.col("next_id").alias("v0"), F.col("vertex_id").alias("v1"), new_id.alias("v2"),
        F.lit(True).alias("synthetic"))
    return Filled(at.unionByName(added), faces.select("scan_id", "face_id", "v0", "v1", "v2", "synthetic").unionByName(fan), loops)


def fan_counts(faces: DataFrame) -> DataFrame:
    """Triangle fans per vertex: components of its faces across the edges at the vertex."""
    rows = F.array(*[F.struct(F.col(f"v{s}").alias("vertex_id"), F.col(f"v{(s + 1) % 3}").alias("p"), F.col(f"v{(s + 2) % 3}").alias("q")) for s in range(3)])
    corner = faces.select("scan_id", "face_id", F.inline(rows))
    # A node is a face corner; two corners at a vertex are linked when they share an edge of it.
    slot = F.when(F.col("vertex_id") == F.col("v0"), 0).when(F.col("vertex_id") == F.col("v1"), 1).otherwise(2)
    corner = corner.join(faces.select("scan_id", "face_id", "v0", "v1", "v2"), ["scan_id", "face_id"]).select(
        "scan_id", "vertex_id", "p", "q", (F.col("face_id") * 3 + slot).alias("node"))
    corner = cut(corner)
    spokes = corner.select("scan_id", "vertex_id", "node", F.explode(F.array("p", "q")).alias("spoke"))
    shared = spokes.groupBy("scan_id", "vertex_id", "spoke").agg(F.min("node").alias("_low"))
    links = spokes.join(shared, ["scan_id", "vertex_id", "spoke"]).filter("node <> _low").select("scan_id", F.col("node").alias("a"), F.col("_low").alias("b"))
    inner = stars(links).select("scan_id", F.col("a").alias("node"), F.lit(1).alias("_in"))
    return corner.join(inner, ["scan_id", "node"], "left").groupBy("scan_id", "vertex_id").agg(
        (F.count("*") - F.sum(F.coalesce("_in", F.lit(0)))).alias("fans"))


def profile_check(entities: DataFrame) -> DataFrame:
    """Connected profiles of entities `(entity_id, start, end)`: size, open ends, branch points."""
    ends = entities.select("scan_id", "entity_id", F.explode(F.array("start", "end")).alias("point"))
    first = ends.groupBy("scan_id", "point").agg(F.min("entity_id").alias("_low"), F.count("*").alias("degree"))
    links = ends.join(first, ["scan_id", "point"]).filter("entity_id <> _low").select("scan_id", F.col("entity_id").alias("a"), F.col("_low").alias("b"))
    parts = cut(components(entities.select("scan_id", "entity_id"), links, node="entity_id"))
    sizes = parts.groupBy("scan_id", "part").agg(F.count("*").alias("entities"))
    at = first.join(parts.withColumnRenamed("entity_id", "_low"), ["scan_id", "_low"]).groupBy("scan_id", "part").agg(
        F.count_if(F.col("degree") == 1).alias("open_ends"), F.count_if(F.col("degree") > 2).alias("branch_points"))
    return sizes.join(at, ["scan_id", "part"]).withColumn("closed", (F.col("open_ends") == 0) & (F.col("branch_points") == 0))
