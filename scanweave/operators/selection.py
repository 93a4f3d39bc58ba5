"""Face sets as tables `(scan_id, face_id)`: algebra, rings, transfers, box and screen picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.vec import V, vec
from scanweave.session import dealt

KEY = ["scan_id", "face_id"]


def add_faces(selection: DataFrame, faces: DataFrame) -> DataFrame:
    return selection.select(*KEY).union(faces.select(*KEY)).distinct()


def remove_faces(selection: DataFrame, faces: DataFrame) -> DataFrame:
    return selection.select(*KEY).join(faces.select(*KEY), KEY, "left_anti")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Faces added and removed between two selections, in one aggregation."""
    marked = before.select(*KEY, F.lit(1).alias("_was"), F.lit(0).alias("_is")).union(
        after.select(*KEY, F.lit(0), F.lit(1))
    )
    both = marked.groupBy(*KEY).agg(F.max("_was").alias("_was"), F.max("_is").alias("_is"))
    return both.filter("_was <> _is").select(
        *KEY, F.when(F.col("_is") == 1, "added").otherwise("removed").alias("change")
    )


def invert_visible(faces: DataFrame, selection: DataFrame, hidden: DataFrame) -> DataFrame:
    taken = selection.select(*KEY).union(hidden.select(*KEY))
    return faces.select(*KEY).join(taken, KEY, "left_anti")


def outer_ring(selection: DataFrame, links: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible unselected neighbours of the selection."""
    reached = links.join(selection.select(*KEY), KEY, "left_semi").select(
        "scan_id", F.col("other").alias("face_id")
    ).distinct()
    return reached.join(selection.select(*KEY).union(hidden.select(*KEY)), KEY, "left_anti")


def inner_ring(selection: DataFrame, links: DataFrame) -> DataFrame:
    """Selected faces with an unselected neighbour; open edges are no border."""
    outside = links.join(selection.select(*KEY), KEY, "left_semi").join(
        selection.select("scan_id", F.col("face_id").alias("other")), ["scan_id", "other"], "left_anti"
    )
    return outside.select(*KEY).distinct()


def remap_faces(selection: DataFrame, face_map: DataFrame) -> DataFrame:
    """The selection on the new mesh; faces without a source belong nowhere."""
    return face_map.join(
        selection.select("scan_id", F.col("face_id").alias("old_face")), ["scan_id", "old_face"], "left_semi"
    ).select("scan_id", F.col("new_face").alias("face_id"))


def remap_labels(labels: DataFrame, face_map: DataFrame) -> DataFrame:
    old = labels.select("scan_id", F.col("face_id").alias("old_face"), "label")
    return face_map.join(old, ["scan_id", "old_face"], "left").select(
        "scan_id", F.col("new_face").alias("face_id"), F.coalesce("label", F.lit(0)).alias("label")
    )


def compose_maps(first: DataFrame, step: DataFrame) -> DataFrame:
    """Face map of `first` followed by `step`, with the synthetic flag carried along."""
    earlier = first.select(
        "scan_id", F.col("new_face").alias("old_face"), F.col("old_face").alias("_source"),
        F.col("synthetic").alias("_synthetic"),
    )
    return step.join(earlier, ["scan_id", "old_face"], "left").select(
        "scan_id", "new_face", F.col("_source").alias("old_face"),
        F.coalesce("_synthetic", "synthetic").alias("synthetic"),
    )


def in_box(geometry: DataFrame, low: tuple, high: tuple, facing: tuple | None = None, max_angle_deg: float = 30.0) -> DataFrame:
    """Faces with their centroid in a box and their normal within a cone."""
    inside: Column = F.lit(True)
    for n, a, b in zip("xyz", low, high):
        inside = inside & F.col(f"g{n}").between(min(a, b), max(a, b))
    if facing is not None:
        direction = V(*[F.lit(float(c)) for c in facing]).unit()
        inside = inside & (vec("n").dot(direction) >= F.cos(F.radians(F.lit(max_angle_deg))))
    return geometry.filter(inside)


def project_to_screen(p: V, matrix: list[float], width: float, height: float) -> tuple[Column, Column, Column]:
    """Screen x, y and visibility of a point under a column-major view matrix."""
    row = lambda k: sum(matrix[k + 4 * c] * v for c, v in enumerate(p)) + matrix[k + 12]
    w = row(3)
    cx, cy, cz = row(0) / w, row(1) / w, row(2) / w
    visible = (w > 0) & cz.between(-1.0, 1.0)
    return (cx + 1) / 2 * width, (1 - cy) / 2 * height, visible


def unclipped(geometry: DataFrame, plane: tuple[float, float, float, float], hidden: DataFrame) -> DataFrame:
    """Faces on the kept side of a clip plane that are not hidden."""
    side = vec("g").dot(V(*[F.lit(float(c)) for c in plane[:3]]))
    return geometry.filter(side <= plane[3]).join(hidden.select(*KEY), KEY, "left_anti")


CELL = 4.0


def in_circles(points: DataFrame, circles: DataFrame, cell: float = CELL) -> DataFrame:
    """Points `(scan_id, face_id, px, py)` inside circles, many circles at once.

    Circles go to the cells their box touches, points to their own cell; only points and
    circles of one cell meet.
    """
    def span(c: str) -> Column:
        low, high = F.col(c) - F.col("radius"), F.col(c) + F.col("radius")
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    spread = dealt(circles, "scan_id", "circle_id").withColumn("_i", F.explode(span("cx"))).withColumn("_j", F.explode(span("cy")))
    placed = points.withColumn("_i", F.floor(F.col("px") / cell)).withColumn("_j", F.floor(F.col("py") / cell))
    gap = F.pow(F.col("px") - F.col("cx"), 2) + F.pow(F.col("py") - F.col("cy"), 2)
    return placed.join(spread.hint("merge"), ["scan_id", "_i", "_j"]).filter(gap <= F.col("radius") * F.col("radius")).select(
        "scan_id", "circle_id", "face_id"
    )


def scanline_spans(edges: DataFrame) -> DataFrame:
    """Pixel spans of polygons by the even-odd rule, sampled at pixel centres.

    `edges(scan_id, polygon_id, x0, y0, x1, y1)`. Every edge is spread over the pixel rows
    it crosses; a row of one polygon holds as many crossings as edges cut it.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.filter("y0 <> y1").withColumn(
        "row", F.explode(F.filter(
            F.sequence(F.floor(low - 0.5), F.ceil(high - 0.5)),
            lambda y: (y + 0.5 >= low) & (y + 0.5 < high),
        ))
    )
    x = F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = rows.groupBy("scan_id", "polygon_id", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pair = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("xs") / 2) - 1),
        lambda n: F.struct(
            F.ceil(F.col("xs")[(2 * n).cast("int")] - 0.5).alias("start"),
            F.ceil(F.col("xs")[(2 * n + 1).cast("int")] - 0.5).alias("stop"),
        ),
    )
    return crossings.select("scan_id", "polygon_id", "row", F.inline(pair)).filter("stop > start")


def in_polygons(points: DataFrame, edges: DataFrame, block: int = 32) -> DataFrame:
    """Points `(scan_id, face_id, px, py)` whose pixel lies in a polygon."""
    # Every edge becomes a span per pixel row, far more than its size tells: never broadcast.
    spans = scanline_spans(dealt(edges, "scan_id", "polygon_id")).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))
    )
    placed = points.select(
        "scan_id", "face_id", F.floor("px").alias("_column"), F.floor("py").alias("row"),
        F.floor(F.floor("px") / block).alias("_block"),
    )
    return placed.join(spans.hint("merge"), ["scan_id", "row", "_block"]).filter("_column >= start AND _column < stop").select(
        "scan_id", "polygon_id", "face_id"
    )
