"""Dense ids without ordering a whole scan in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536


def dense_ids(df: DataFrame, key: str, out: str, block: int = BLOCK) -> DataFrame:
    """Number the rows of every scan by `key` from 0.

    Ids are counted per block of the key range; a running total over the few block
    counts gives each block its offset, and rows are ordered inside a block only.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    counts = blocked.groupBy("scan_id", "_block").agg(F.count("*").alias("_n"))
    # A second level keeps the running total short for any id range.
    outer = counts.withColumn("_outer", F.floor(F.col("_block") / block))
    totals = outer.groupBy("scan_id", "_outer").agg(F.sum("_n").alias("_total"))
    before = F.sum("_total").over(W.partitionBy("scan_id").orderBy("_outer").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("scan_id", "_outer", F.coalesce(before, F.lit(0)).alias("_start"))
    inner = F.sum("_n").over(W.partitionBy("scan_id", "_outer").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = outer.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(starts, ["scan_id", "_outer"]).select(
        "scan_id", "_block", (F.col("_inner") + F.col("_start")).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("scan_id", "_block").orderBy(key)) - 1
    return blocked.withColumn("_rank", rank).join(offsets, ["scan_id", "_block"]).withColumn(
        out, F.col("_offset") + F.col("_rank")
    ).drop("_block", "_rank", "_offset")
