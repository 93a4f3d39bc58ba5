"""Connected components, growth and distances on graphs kept as edge tables.

Nodes are `(scan_id, id)`. Components first shrink edges inside each partition, then
alternate large-star and small-star steps until every node points at the smallest id
of its component. Each round is cut to a written table. Edges dealt by their place shrink
to one star per part and chunk first; only nodes met in several chunks take part in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.session import cut, few

CHUNK_EDGES = 200_000
MAX_ROUNDS = 60


def _local_stars(frame: pd.DataFrame, roots: bool = False) -> pd.DataFrame:
    """Edges of one chunk replaced by (node, smallest node of its local component); `roots` keeps the smallest ones."""
    scan, scans = pd.factorize(frame["scan_id"])
    ids, rank = np.unique(np.r_[frame["a"].to_numpy(), frame["b"].to_numpy()], return_inverse=True)
    packed = (np.r_[scan, scan].astype(np.int64) << 32) | rank
    nodes, index = np.unique(packed, return_inverse=True)
    left, right = index[: len(frame)], index[len(frame):]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        open_edges = lo != hi
        if not open_edges.any():
            break
        left, right = left[open_edges], right[open_edges]
        np.minimum.at(root, hi[open_edges], lo[open_edges])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    moved = np.arange(len(nodes)) if roots else np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({
        "scan_id": np.asarray(scans)[nodes[moved] >> 32],
        "a": ids[nodes[moved] & 0xFFFFFFFF],
        "b": ids[nodes[root[moved]] & 0xFFFFFFFF],
    })


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK_EDGES:
            yield _local_stars(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield _local_stars(pd.concat(held, ignore_index=True))


def _shrink_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        # A range is about one chunk; a larger one is dealt with in chunks.
        if rows >= 2 * CHUNK_EDGES:
            yield _local_stars(pd.concat(held, ignore_index=True), roots=True)
            held, rows = [], 0
    if rows:
        yield _local_stars(pd.concat(held, ignore_index=True), roots=True)


_EDGE_SCHEMA = "scan_id string, a long, b long"


def _is_stars(edges: DataFrame) -> bool:
    """True when every node has one parent and no parent has a parent itself."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")),
    )
    roles = (
        edges.select("scan_id", F.inline(ends))
        .groupBy("scan_id", "node")
        .agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    )
    return roles.filter((F.col("children") > 1) | ((F.col("children") == 1) & (F.col("parent") == 1))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                   F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    sym = edges.select("scan_id", F.inline(both))
    smallest = sym.groupBy("scan_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        sym.filter("v > u").join(smallest, ["scan_id", "u"])
        .select("scan_id", F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("scan_id", "a").agg(F.min("b").alias("m"))
    joined = edges.join(smallest, ["scan_id", "a"])
    pairs = F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
                    F.struct(F.col("a").alias("x"), F.col("m").alias("y")))
    return (
        joined.select("scan_id", F.inline(pairs)).filter("x <> y")
        .select("scan_id", F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )


def stars(links: DataFrame) -> DataFrame:
    """`(scan_id, a, b)`: every node that is not the smallest of its component, with that node."""
    edges = cut(links.select("scan_id", "a", "b").mapInPandas(_shrink, _EDGE_SCHEMA))
    for _ in range(MAX_ROUNDS):
        if _is_stars(edges):
            return edges
        grown = _small_star(_large_star(edges))
        edges = cut(grown.mapInPandas(_shrink, _EDGE_SCHEMA))
    raise RuntimeError("components did not settle")


def near_by(rows: DataFrame, near: str, edges: int = 1) -> DataFrame:
    """`rows` dealt in ranges of `near`, so that edges that share a node mostly meet; a row holds `edges` edges."""
    return rows.repartitionByRange(max(1, -(-rows.count() * edges // CHUNK_EDGES)), "scan_id", near)


def stars_near(links: DataFrame) -> DataFrame:
    """`stars` for links dealt by `near_by`; how they are dealt decides the work, never the result."""
    local = cut(links.select("scan_id", "a", "b").mapInPandas(_shrink_near, _EDGE_SCHEMA))
    node = cut(local.groupBy("scan_id", "a").agg(F.min("b").alias("b"), F.max("b").alias("_high"), F.count("*").alias("_n")))
    shared = node.filter("b <> _high")
    # A node of several chunks ties their smallest nodes together.
    ties = shared.select("scan_id", F.col("_high").alias("a"), "b")
    often = few(shared.filter("_n > 2").select("scan_id", "a", F.col("b").alias("_low")))
    more = local.join(often, ["scan_id", "a"]).filter("b <> _low").select("scan_id", F.col("b").alias("a"), F.col("_low").alias("b"))
    top = few(stars(ties.unionByName(more)).select("scan_id", F.col("a").alias("b"), F.col("b").alias("_root")))
    found = node.select("scan_id", "a", "b").join(top, ["scan_id", "b"], "left")
    return found.select("scan_id", "a", F.coalesce("_root", "b").alias("b")).filter("a <> b")


def stars_placed(links: DataFrame, expand=None, edges: int = 1) -> DataFrame:
    """`stars` of `links(scan_id, a, b)`, by their places when they tell them (`near`).

    `expand` makes the `edges` links of a row, after the rows are dealt.
    """
    if "near" not in links.columns:
        return stars(expand(links) if expand else links)
    dealt = near_by(cut(links), "near", edges)
    return stars_near(expand(dealt) if expand else dealt)


def components(nodes: DataFrame, links: DataFrame, node: str = "face_id") -> DataFrame:
    """Component of every node, named by the smallest id in it (`part`); links may tell their place (`near`)."""
    found = stars_placed(links).select("scan_id", F.col("a").alias(node), F.col("b").alias("_root"))
    return nodes.join(found, ["scan_id", node], "left").select(
        *nodes.columns, F.coalesce("_root", node).alias("part")
    )


def edge_parts(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parts connected across manifold edges."""
    return components(faces.select("scan_id", "face_id"), pairs.select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b")))


def vertex_parts(faces: DataFrame) -> DataFrame:
    """Parts of faces connected through shared vertices, named by their smallest vertex; faces may tell their place (`near`)."""
    corners = faces.select("scan_id", "v0", "v1", "v2", *[c for c in ("near",) if c in faces.columns])
    links = F.array(*[F.struct(F.col(f"v{s}").alias("a"), F.col(f"v{s + 1}").alias("b")) for s in (0, 1)])
    found = stars_placed(corners, lambda rows: rows.select("scan_id", F.inline(links)).filter("a <> b"), edges=2)
    return faces.join(
        found.select("scan_id", F.col("a").alias("v0"), F.col("b").alias("_root")), ["scan_id", "v0"], "left"
    ).select("scan_id", "face_id", F.coalesce("_root", "v0").alias("part"))


def grow(
    seeds: DataFrame, links: DataFrame, rings: int | None = None, allowed: DataFrame | None = None
) -> DataFrame:
    """Faces within `rings` steps of a seed with their ring distance; None grows to the end.

    `links(scan_id, face_id, other)` holds both directions. The visited table and the
    frontier are written each round, so a long growth keeps a short plan.
    """
    if allowed is not None:
        links = links.join(
            allowed.select("scan_id", F.col("face_id").alias("other")), ["scan_id", "other"], "left_semi"
        )
    links = cut(links.select("scan_id", "face_id", "other"))
    frontier = cut(seeds.select("scan_id", "face_id").distinct().withColumn("ring", F.lit(0)))
    seen, ring = frontier, 0
    while rings is None or ring < rings:
        ring += 1
        reached = links.join(frontier.select("scan_id", "face_id"), ["scan_id", "face_id"], "left_semi")
        frontier = cut(
            reached.select("scan_id", F.col("other").alias("face_id")).distinct()
            .join(seen, ["scan_id", "face_id"], "left_anti").withColumn("ring", F.lit(ring))
        )
        if frontier.isEmpty():
            break
        # The union of written tables stays cheap to read; it is merged now and then.
        seen = seen.unionByName(frontier)
        if ring % 8 == 0:
            seen = cut(seen)
    return seen
