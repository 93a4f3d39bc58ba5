"""Region labels: sizes, adjacency, matching, free labels, edits, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["scan_id", "face_id"]

# Fixed values.
MATCH_IOU = 0.5


def label_sizes(labels: DataFrame, areas: DataFrame) -> DataFrame:
    return labels.join(areas, KEY).groupBy("scan_id", "label").agg(
        F.count("*").alias("faces"), F.sum("area").alias("area")
    )


def adjacency(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of labels that share a mesh edge, with the number of shared edges."""
    a = labels.select("scan_id", F.col("face_id").alias("fa"), F.col("label").alias("la"))
    b = labels.select("scan_id", F.col("face_id").alias("fb"), F.col("label").alias("lb"))
    met = pairs.join(a, ["scan_id", "fa"]).join(b, ["scan_id", "fb"])
    return (
        met.filter("la <> lb AND la > 0 AND lb > 0")
        .groupBy("scan_id", F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high"))
        .agg(F.count("*").alias("shared_edges"))
    )


def match_regions(pairs: DataFrame) -> DataFrame:
    """Old and new labels whose faces overlap with IoU above one half.

    `pairs(scan_id, face_id, old_label, new_label)`; the overlap table is counted once and
    both label sizes are sums of it, so faces shuffle a single time.
    """
    overlap = pairs.groupBy("scan_id", "old_label", "new_label").agg(F.count("*").alias("shared"))
    old = overlap.groupBy("scan_id", "old_label").agg(F.sum("shared").alias("_old"))
    new = overlap.groupBy("scan_id", "new_label").agg(F.sum("shared").alias("_new"))
    union = F.col("_old") + F.col("_new") - F.col("shared")
    return (
        overlap.filter("old_label > 0 AND new_label > 0")
        .join(old, ["scan_id", "old_label"]).join(new, ["scan_id", "new_label"])
        .filter(F.col("shared") > MATCH_IOU * union)
        .select("scan_id", "old_label", "new_label", "shared", union.alias("union_faces"))
    )


def free_labels(used: DataFrame, wanted: DataFrame) -> DataFrame:
    """The smallest free labels per scan with their rank from 1.

    `wanted(scan_id, n)`. The n smallest free labels lie in 1 … n + used.
    """
    taken = used.select("scan_id", "label").filter("label > 0").distinct()
    counts = taken.groupBy("scan_id").agg(F.count("*").alias("_used"))
    span = wanted.filter("n > 0").join(counts, "scan_id", "left").select(
        "scan_id", "n", F.explode(F.sequence(F.lit(1), (F.col("n") + F.coalesce("_used", F.lit(0))).cast("int"))).alias("label")
    )
    rank = F.row_number().over(W.partitionBy("scan_id").orderBy("label"))
    return span.join(taken, ["scan_id", "label"], "left_anti").withColumn("rank", rank).filter(
        F.col("rank") <= F.col("n")
    ).select("scan_id", "label", "rank")


def compact_labels(labels: DataFrame) -> DataFrame:
    """Renumber labels by descending size."""
    sizes = labels.filter("label > 0").groupBy("scan_id", "label").agg(F.count("*").alias("n"))
    order = W.partitionBy("scan_id").orderBy(F.desc("n"), "label")
    ranks = sizes.select("scan_id", "label", F.row_number().over(order).alias("new_label"))
    return labels.join(ranks, ["scan_id", "label"], "left").select(
        *KEY, F.coalesce("new_label", F.lit(0)).alias("label")
    )


def apply_edits(labels: DataFrame, edits: DataFrame) -> DataFrame:
    """Face edits `(scan_id, face_id, op, label)`: `set` steals faces, `remove` frees them
    when they belong to the label."""
    change = edits.select(*KEY, "op", F.col("label").alias("_target"))
    new = (
        F.when(F.col("op") == "set", F.col("_target"))
        .when((F.col("op") == "remove") & (F.col("label") == F.col("_target")), F.lit(0))
        .otherwise(F.col("label"))
    )
    return labels.join(change, KEY, "left").select(*KEY, new.alias("label"))


def merge_into_largest(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Join the labels of a group `(scan_id, group_id, label)` into its largest one."""
    sizes = labels.groupBy("scan_id", "label").agg(F.count("*").alias("n"))
    ranked = groups.join(sizes, ["scan_id", "label"])
    target = ranked.groupBy("scan_id", "group_id").agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("_target")
    )
    moves = groups.join(target, ["scan_id", "group_id"]).select("scan_id", "label", "_target")
    return labels.join(moves, ["scan_id", "label"], "left").select(
        *KEY, F.coalesce("_target", "label").alias("label")
    )


def delete_labels(labels: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select("scan_id", "label", F.lit(True).alias("_gone"))
    return labels.join(gone, ["scan_id", "label"], "left").select(
        *KEY, F.when(F.col("_gone"), 0).otherwise(F.col("label")).alias("label")
    )


def merge_segmentation(old: DataFrame, found: DataFrame) -> DataFrame:
    """A new segmentation of some faces put over kept labels.

    `found(scan_id, face_id, label)` holds the segmented faces; label 0 means none. A found
    region that overlaps an old one by more than half takes its label, the others take the
    smallest labels nobody keeps.
    """
    both = old.join(found.withColumnRenamed("label", "_found"), KEY, "left")
    matches = match_regions(
        both.select(*KEY, F.col("label").alias("old_label"), F.coalesce("_found", F.lit(0)).alias("new_label"))
    ).select("scan_id", F.col("new_label").alias("_found"), F.col("old_label").alias("_value"))
    surviving = both.filter(F.col("_found").isNull() & (F.col("label") > 0)).select("scan_id", "label").distinct()
    fresh_from = found.filter("label > 0").select("scan_id", F.col("label").alias("_found")).distinct().join(
        matches.select("scan_id", "_found"), ["scan_id", "_found"], "left_anti"
    )
    order = F.row_number().over(W.partitionBy("scan_id").orderBy("_found"))
    fresh_from = fresh_from.withColumn("rank", order)
    wanted = fresh_from.groupBy("scan_id").agg(F.count("*").alias("n"))
    free = free_labels(surviving.union(matches.select("scan_id", F.col("_value").alias("label"))), wanted)
    fresh = fresh_from.join(free, ["scan_id", "rank"]).select("scan_id", "_found", F.col("label").alias("_value"))
    values = matches.unionByName(fresh)
    label = F.when(F.col("_found") > 0, F.col("_value")).when(F.col("_found").isNull(), F.col("label")).otherwise(0)
    return both.join(values, ["scan_id", "_found"], "left").select(*KEY, label.cast("int").alias("label"))
