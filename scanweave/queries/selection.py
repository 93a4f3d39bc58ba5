"""Face sets, picks, transfers and region labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.checks import r, sql
from scanweave.fixtures import scan_name
from scanweave.functions.vec import r6, vec
from scanweave.operators import mesh, regions, repair, selection as sel
from scanweave.registry import query

HIDDEN = "SELECT scan_id, face_id FROM faces WHERE face_id % 11 = 0"


def hidden(t):
    return t.faces.filter("face_id % 11 = 0").select("scan_id", "face_id")


def links(t):
    return mesh.neighbours(mesh.face_pairs(t.faces))


def geometry(t):
    return mesh.face_geometry(mesh.corners(t.vertices, t.faces, carry=[]))


@query("x01_add_faces", sql("SELECT scan_id, face_id FROM selection UNION SELECT scan_id, face_id FROM other_selection"))
def _(t):
    return sel.add_faces(t.selection, t.other_selection)


@query("x01_added_change", sql("SELECT scan_id, face_id FROM other_selection EXCEPT SELECT scan_id, face_id FROM selection"))
def _(t):
    return sel.remove_faces(t.other_selection, t.selection)


@query("x01_remove_faces", sql("SELECT scan_id, face_id FROM selection EXCEPT SELECT scan_id, face_id FROM other_selection"))
def _(t):
    return sel.remove_faces(t.selection, t.other_selection)


@query("x02_invert_visible", sql("""SELECT scan_id, face_id FROM faces EXCEPT SELECT * FROM selection EXCEPT SELECT * FROM hidden""", hidden=HIDDEN))
def _(t):
    return sel.invert_visible(t.faces, t.selection, hidden(t))


@query("x03_difference", sql("""SELECT scan_id, face_id, 'added' AS change FROM (SELECT * FROM other_selection EXCEPT SELECT * FROM selection)
    UNION ALL SELECT scan_id, face_id, 'removed' FROM (SELECT * FROM selection EXCEPT SELECT * FROM other_selection)"""))
def _(t):
    return sel.difference(t.selection, t.other_selection)


@query("x04_outer_ring", sql("""SELECT scan_id, other AS face_id FROM links WHERE face_id IN (SELECT face_id FROM selection)
    EXCEPT SELECT * FROM selection EXCEPT SELECT * FROM hidden""", hidden=HIDDEN))
def _(t):
    return sel.outer_ring(t.selection, links(t), hidden(t))


@query("x04_inner_ring", sql("""SELECT DISTINCT scan_id, face_id FROM links WHERE face_id IN (SELECT face_id FROM selection)
    AND other NOT IN (SELECT face_id FROM selection)"""))
def _(t):
    return sel.inner_ring(t.selection, links(t))


MAPS = {
    "first_map": """SELECT scan_id, face_id + 5 AS new_face, CASE WHEN face_id % 13 <> 0 THEN face_id END AS old_face,
        face_id % 13 = 0 AS synthetic FROM faces""",
    "second_map": """SELECT scan_id, face_id * 2 AS new_face, CASE WHEN face_id % 17 <> 0 THEN face_id + 5 END AS old_face,
        face_id % 17 = 0 AS synthetic FROM faces WHERE face_id % 19 <> 0""",
}


def first_map(t):
    f = F.col("face_id")
    return t.faces.select("scan_id", (f + 5).alias("new_face"), F.when(f % 13 != 0, f).alias("old_face"), (f % 13 == 0).alias("synthetic"))


def second_map(t):
    f = F.col("face_id")
    return t.faces.filter(f % 19 != 0).select(
        "scan_id", (f * 2).alias("new_face"), F.when(f % 17 != 0, f + 5).alias("old_face"), (f % 17 == 0).alias("synthetic"))


@query("j04_remap_face_set", sql("SELECT scan_id, new_face AS face_id FROM first_map WHERE old_face IN (SELECT face_id FROM selection)", **MAPS))
def _(t):
    return sel.remap_faces(t.selection, first_map(t))


@query("j04_remap_labels", sql("""SELECT m.scan_id, new_face AS face_id, coalesce(label, 0) AS label FROM first_map m
    LEFT JOIN region_labels l ON l.face_id = old_face""", **MAPS))
def _(t):
    return sel.remap_labels(t.labels, first_map(t))


@query("j05_compose_maps", sql("""SELECT s.scan_id, s.new_face, f.old_face, coalesce(f.synthetic, s.synthetic) AS synthetic
    FROM second_map s LEFT JOIN first_map f ON f.new_face = s.old_face""", **MAPS))
def _(t):
    return sel.compose_maps(first_map(t), second_map(t))


@query("x05_affected_faces", sql("""SELECT scan_id, face_id FROM selection UNION
    SELECT f.scan_id, f.old_face FROM first_map f JOIN other_selection o ON o.face_id = f.new_face AND o.scan_id = f.scan_id WHERE f.old_face IS NOT NULL""", **MAPS))
def _(t):
    earlier = first_map(t).join(
        t.other_selection.withColumnRenamed("face_id", "new_face"), ["scan_id", "new_face"], "left_semi"
    ).filter("old_face IS NOT NULL").select("scan_id", F.col("old_face").alias("face_id"))
    return sel.add_faces(t.selection, earlier)


@query("x08_dry_run", sql("""SELECT scan_id, count(*) FILTER (face_id % 89 = 0) AS degenerate_faces, count(*) FILTER (face_id % 97 = 0) AS duplicate_faces,
    true AS changed FROM tiled_faces GROUP BY scan_id"""))
def _(t):
    flat = repair.degenerate_faces(t.vertices, t.dirty_faces)
    solid = repair.without(t.dirty_faces, flat)
    distinct = repair.distinct_faces(solid)
    count = lambda df, n: df.groupBy("scan_id").agg(F.count("*").alias(n))
    row = count(t.dirty_faces, "n").join(count(flat, "degenerate_faces"), "scan_id", "left").join(
        count(solid, "s"), "scan_id").join(count(distinct, "d"), "scan_id").na.fill(0)
    return row.select("scan_id", "degenerate_faces", (F.col("s") - F.col("d")).alias("duplicate_faces"),
                      (F.col("n") > F.col("d")).alias("changed"))


@query("x08_affected", sql("SELECT scan_id, face_id FROM dirty_faces WHERE face_id >= 1000000000"))
def _(t):
    flat = repair.degenerate_faces(t.vertices, t.dirty_faces)
    solid = repair.without(t.dirty_faces, flat)
    return flat.union(repair.without(solid, repair.distinct_faces(solid)).select("scan_id", "face_id"))


@query("f03_faces_in_box", sql("""SELECT scan_id, face_id FROM normals WHERE gx BETWEEN 12 AND 58 AND gy BETWEEN 2 AND 30 AND gz BETWEEN 0 AND 0.07
    AND nx * 0.6 + nz * 0.8 >= cos(radians(37.2))"""))
def _(t):
    return sel.in_box(geometry(t), (12, 2, 0), (58, 30, 0.07), (3, 0, 4), 37.2).select("scan_id", "face_id")


# A perspective view matrix (column major) and a screen of 800 x 600.
VIEW = [1.2, 0.0, 0.0, 0.0, 0.0, 1.6, 0.0, 0.0, 0.1, 0.2, -1.05, -0.9, -60.0, -40.0, 90.0, 100.0]
_ROW = lambda k: "(" + " + ".join(f"{VIEW[k + 4 * c]}::DOUBLE * g{a}" for c, a in enumerate("xyz")) + f" + {VIEW[k + 12]}::DOUBLE)"
SCREEN = {"screen": f"""SELECT scan_id, face_id, ({_ROW(0)} / {_ROW(3)} + 1) / 2 * 800 AS px, (1 - {_ROW(1)} / {_ROW(3)}) / 2 * 600 AS py FROM geo
    WHERE {_ROW(3)} > 0 AND {_ROW(2)} / {_ROW(3)} BETWEEN -1 AND 1"""}


def screen(t):
    px, py, seen = sel.project_to_screen(vec("g"), VIEW, 800.0, 600.0)
    return geometry(t).select("scan_id", "face_id", px.alias("px"), py.alias("py"), seen.alias("seen")).filter("seen").drop("seen")


@query("p21_screen_projection", sql(f"SELECT scan_id, face_id, {r('px')} AS px, {r('py')} AS py FROM screen", **SCREEN))
def _(t):
    return screen(t).select("scan_id", "face_id", r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


CIRCLES = {"circles": """SELECT 'scan_' || (c_custkey % 5) AS scan_id, c_custkey AS circle_id, (c_custkey * 37 % 800)::DOUBLE AS cx,
    (c_custkey * 53 % 600)::DOUBLE AS cy, 1.0::DOUBLE + c_custkey % 9 AS radius FROM customer"""}


def circles(t):
    k = F.col("c_custkey")
    return t.read("customer").select(
        scan_name(k).alias("scan_id"), k.alias("circle_id"), (k * 37 % 800).cast("double").alias("cx"),
        (k * 53 % 600).cast("double").alias("cy"), (F.lit(1.0) + k % 9).alias("radius"))


@query("f04_faces_in_circles", sql("""SELECT c.scan_id, circle_id, face_id FROM circles c JOIN screen s ON s.scan_id = c.scan_id
    AND (px - cx) * (px - cx) + (py - cy) * (py - cy) <= radius * radius""", **SCREEN, **CIRCLES))
def _(t):
    return sel.in_circles(screen(t), circles(t))


# One diamond-with-a-notch polygon per customer on the screen.
SHAPE = ((0, -9), (8, 0), (3, 1), (7, 6), (0, 9), (-8, 1))
_EDGE = " UNION ALL ".join(
    f"SELECT {n} AS n, {a[0]} AS a0, {a[1]} AS a1, {b[0]} AS b0, {b[1]} AS b1"
    for n, (a, b) in enumerate(zip(SHAPE, SHAPE[1:] + SHAPE[:1])))
POLYGONS = {"polygon_edges": f"""SELECT scan_id, circle_id AS polygon_id, cx + radius * a0 + 0.25::DOUBLE AS x0, cy + radius * a1 + 0.125::DOUBLE AS y0,
    cx + radius * b0 + 0.25::DOUBLE AS x1, cy + radius * b1 + 0.125::DOUBLE AS y1 FROM circles, ({_EDGE}) e"""}


def polygon_edges(t):
    corner = lambda p: (F.col("cx") + F.col("radius") * p[0] + 0.25, F.col("cy") + F.col("radius") * p[1] + 0.125)
    rows = F.array(*[
        F.struct(corner(a)[0].alias("x0"), corner(a)[1].alias("y0"), corner(b)[0].alias("x1"), corner(b)[1].alias("y1"))
        for a, b in zip(SHAPE, SHAPE[1:] + SHAPE[:1])])
    return circles(t).select("scan_id", F.col("circle_id").alias("polygon_id"), F.inline(rows))


@query("f05_faces_in_polygons", sql("""SELECT p.scan_id, polygon_id, face_id FROM polygon_edges p JOIN screen s ON s.scan_id = p.scan_id
    AND (y0 > floor(py) + 0.5::DOUBLE) <> (y1 > floor(py) + 0.5::DOUBLE)
    AND ceil(x0 + (floor(py) + 0.5::DOUBLE - y0) * (x1 - x0) / (y1 - y0) - 0.5::DOUBLE) > floor(px)
    GROUP BY ALL HAVING count(*) % 2 = 1""", **SCREEN, **CIRCLES, **POLYGONS))
def _(t):
    return sel.in_polygons(screen(t), polygon_edges(t))


@query("f06_unclipped", sql("""SELECT scan_id, face_id FROM geo WHERE 0.6::DOUBLE * gx + 0.8::DOUBLE * gy <= 50.01
    AND face_id NOT IN (SELECT face_id FROM hidden)""", hidden=HIDDEN))
def _(t):
    return sel.unclipped(geometry(t), (0.6, 0.8, 0.0, 50.01), hidden(t)).select("scan_id", "face_id")


@query("f14_usable_faces", sql("""SELECT scan_id, face_id, label FROM region_labels JOIN faces USING (scan_id, face_id) WHERE NOT synthetic AND label > 0
    QUALIFY count(*) OVER (PARTITION BY scan_id, label) >= 40"""))
def _(t):
    usable = t.labels.filter("label > 0").join(t.faces.filter("NOT synthetic"), ["scan_id", "face_id"], "left_semi")
    large = usable.groupBy("scan_id", "label").count().filter("count >= 40")
    return usable.join(large, ["scan_id", "label"], "left_semi").select("scan_id", "face_id", "label")


@query("j19_faces_along_loops", sql("""SELECT DISTINCT h.scan_id, h.face_id FROM half_edges h JOIN edges e ON e.lo = least(src, dst) AND e.hi = greatest(src, dst)
    WHERE valence = 1"""))
def _(t):
    return mesh.boundary(t.faces).select("scan_id", "face_id").distinct()


@query("j23_region_adjacency", sql("""SELECT p.scan_id, least(a.label, b.label) AS low, greatest(a.label, b.label) AS high, count(*) AS shared_edges
    FROM pairs p JOIN region_labels a ON a.face_id = fa JOIN region_labels b ON b.face_id = fb
    WHERE a.label <> b.label AND a.label > 0 AND b.label > 0 GROUP BY ALL"""))
def _(t):
    return regions.adjacency(t.labels, mesh.face_pairs(t.faces))


@query("j24_faces_with_label", sql("SELECT scan_id, face_id FROM region_labels WHERE label % 6 = 1"))
def _(t):
    chosen = t.labels.filter("label % 6 = 1").select("scan_id", "label").distinct()
    return t.labels.join(chosen, ["scan_id", "label"], "left_semi").select("scan_id", "face_id")


@query("a13_label_sizes", sql(f"""SELECT scan_id, label, count(*) AS faces, {r('sum(area)')} AS area FROM normals JOIN region_labels USING (scan_id, face_id)
    GROUP BY ALL"""))
def _(t):
    s = regions.label_sizes(t.labels, geometry(t).select("scan_id", "face_id", "area"))
    return s.withColumn("area", r6(F.col("area")))


@query("a14_match_regions", sql("""SELECT * FROM (SELECT o.scan_id, o.old_label, o.new_label, shared, a.n + b.n - shared AS union_faces FROM o
    JOIN (SELECT scan_id, old_label, count(*) AS n FROM region_pairs GROUP BY ALL) a USING (scan_id, old_label)
    JOIN (SELECT scan_id, new_label, count(*) AS n FROM region_pairs GROUP BY ALL) b USING (scan_id, new_label)
    WHERE old_label > 0 AND new_label > 0) WHERE shared > 0.5 * union_faces""",
    o="SELECT scan_id, old_label, new_label, count(*) AS shared FROM region_pairs GROUP BY ALL"))
def _(t):
    return regions.match_regions(t.region_pairs)


@query("t01_compact_labels", sql("""SELECT scan_id, face_id, coalesce(k, 0) AS label FROM region_labels LEFT JOIN (SELECT scan_id, label,
    row_number() OVER (PARTITION BY scan_id ORDER BY count(*) DESC, label) AS k FROM region_labels WHERE label > 0 GROUP BY scan_id, label)
    USING (scan_id, label)"""))
def _(t):
    return regions.compact_labels(t.labels)


USED = "SELECT DISTINCT scan_id, old_label AS label FROM region_pairs WHERE old_label % 3 <> 0 AND old_label > 0"


@query("t05_free_labels", sql("""SELECT scan_id, label, k AS rank FROM (SELECT scan_id, label, row_number() OVER (PARTITION BY scan_id ORDER BY label) AS k
    FROM (SELECT DISTINCT scan_id FROM region_pairs), (SELECT range AS label FROM range(1, 2000)) WHERE (scan_id, label) NOT IN (SELECT scan_id, label FROM used))
    WHERE k <= 40""", used=USED))
def _(t):
    used = t.region_pairs.filter("old_label % 3 <> 0").select("scan_id", F.col("old_label").alias("label"))
    wanted = t.region_pairs.select("scan_id").distinct().withColumn("n", F.lit(40))
    return regions.free_labels(used, wanted)


@query("x06_create_and_remove", sql("""SELECT l.scan_id, l.face_id, CASE WHEN l.face_id % 10 = 1 THEN 60001 WHEN l.face_id % 10 = 2 AND label % 4 = 1 THEN 0
    ELSE label END AS label FROM region_labels l"""))
def _(t):
    f = F.col("face_id")
    edits = t.faces.filter((f % 10 == 1) | (f % 10 == 2)).select(
        "scan_id", "face_id", F.when(f % 10 == 1, "set").otherwise("remove").alias("op"))
    target = t.labels.select("scan_id", "face_id", F.when(F.col("label") % 4 == 1, F.col("label")).otherwise(-1).alias("own"))
    edits = edits.join(target, ["scan_id", "face_id"]).select(
        "scan_id", "face_id", "op", F.when(F.col("op") == "set", 60001).otherwise(F.col("own")).alias("label"))
    return regions.apply_edits(t.labels, edits)


@query("x06_merge_regions", sql("""SELECT l.scan_id, l.face_id, coalesce(target, label) AS label FROM region_labels l LEFT JOIN (SELECT scan_id, label,
    first_value(label) OVER (PARTITION BY scan_id, (label - 1) // 4 ORDER BY n DESC, label) AS target FROM s WHERE label > 0) USING (scan_id, label)""",
    s="SELECT scan_id, label, count(*) AS n FROM region_labels GROUP BY ALL"))
def _(t):
    groups = t.labels.filter("label > 0").select("scan_id", "label").distinct().withColumn(
        "group_id", F.floor((F.col("label") - 1) / 4))
    return regions.merge_into_largest(t.labels, groups)


@query("x06_delete_regions", sql("SELECT scan_id, face_id, CASE WHEN label % 5 = 2 THEN 0 ELSE label END AS label FROM region_labels"))
def _(t):
    gone = t.labels.filter("label % 5 = 2").select("scan_id", "label").distinct()
    return regions.delete_labels(t.labels, gone)


@query("x07_merge_segmentation", sql("""SELECT b.scan_id, face_id, CASE WHEN found IS NULL THEN old_label WHEN found = 0 THEN 0
    ELSE coalesce(m.old_label_m, f.label) END AS label FROM b LEFT JOIN m ON m.scan_id = b.scan_id AND m.found_m = b.found
    LEFT JOIN fresh f ON f.scan_id = b.scan_id AND f.found_f = b.found""",
    b="SELECT scan_id, face_id, old_label, CASE WHEN face_id % 10 <> 0 OR face_id % 100 > 60 THEN new_label END AS found FROM region_pairs",
    o="SELECT scan_id, old_label, coalesce(found, 0) AS found, count(*) AS shared FROM b GROUP BY ALL",
    m="""SELECT o.scan_id, o.old_label AS old_label_m, o.found AS found_m FROM o JOIN (SELECT scan_id, old_label, sum(shared) AS n FROM o GROUP BY ALL) x
        USING (scan_id, old_label) JOIN (SELECT scan_id, found, sum(shared) AS n FROM o GROUP BY ALL) y USING (scan_id, found)
        WHERE o.old_label > 0 AND o.found > 0 AND shared > 0.5 * (x.n + y.n - shared)""",
    used="""SELECT scan_id, old_label AS label FROM b WHERE found IS NULL AND old_label > 0 UNION SELECT scan_id, old_label_m FROM m""",
    want="""SELECT scan_id, found AS found_f, row_number() OVER (PARTITION BY scan_id ORDER BY found) AS k FROM
        (SELECT DISTINCT scan_id, found FROM b WHERE found > 0) d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scan_id = d.scan_id AND m.found_m = d.found)""",
    free="""SELECT scan_id, label, row_number() OVER (PARTITION BY scan_id ORDER BY label) AS k FROM (SELECT DISTINCT scan_id FROM region_pairs),
        (SELECT range AS label FROM range(1, 9000)) WHERE (scan_id, label) NOT IN (SELECT scan_id, label FROM used)""",
    fresh="SELECT w.scan_id, w.found_f, f.label FROM want w JOIN free f USING (scan_id, k)"))
def _(t):
    p, f = t.region_pairs, F.col("face_id")
    found = p.filter((f % 10 != 0) | (f % 100 > 60)).select("scan_id", "face_id", F.col("new_label").alias("label"))
    return regions.merge_segmentation(p.select("scan_id", "face_id", F.col("old_label").alias("label")), found)
