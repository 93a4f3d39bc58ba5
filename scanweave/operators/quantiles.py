"""Exact percentiles of hot groups without collecting a group in one task.

A mergeable sketch brackets each wanted rank, equal values in the bracket are counted
before any shuffle, and only the few distinct values inside the bracket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanweave.session import cut, cut_counting, few

ACCURACY = 10_000
FEW_GROUPS = 20_000


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float], rank: str = "linear"
) -> DataFrame:
    """Percentiles (`wanted`: output column -> share) per key.

    `rank="linear"` interpolates between the two ranks around (n - 1) p; `rank="index"`
    takes the value at index floor(n p).

    NULL and NaN values do not count. At most about 4 in 10,000 rows of a group lie in
    a bracket; groups up to 10,000 rows are ordered whole, all of them in one shuffle.
    """
    v = F.col(value) if isinstance(value, str) else value
    # As in a join, rows without a key belong to no group; -0.0 counts as 0.0.
    rows = df.select(*keys, (v + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).dropna(subset=keys)
    sizes, large = cut_counting(rows.groupBy(*keys).agg(F.count("*").alias("_n")), F.col("_n") > ACCURACY)
    if not large:
        return _ordered_whole(rows, keys, wanted, rank)
    big = few(sizes.filter(F.col("_n") > ACCURACY).select(*keys), FEW_GROUPS)
    out = _bracketed(rows.join(big, keys, "left_semi"), keys, wanted, rank)
    if sizes.filter(F.col("_n") <= ACCURACY).isEmpty():
        return out
    return out.unionByName(_ordered_whole(rows.join(big, keys, "left_anti"), keys, wanted, rank))


def _position(p: float, rank: str) -> Column:
    if rank == "index":
        return F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1).cast("double")
    return (F.col("_n") - 1) * F.lit(p)


def _ordered_whole(rows: DataFrame, keys: list[str], wanted: dict[str, float], rank: str) -> DataFrame:
    """Percentiles of groups short enough to be ordered, in one shuffle."""
    group = W.partitionBy(*keys)
    ordered = rows.withColumns({"_row": F.row_number().over(group.orderBy("_v")) - 1, "_n": F.count("*").over(group)})
    at = {name: _position(p, rank) for name, p in wanted.items()}
    value = lambda place: F.min(F.when(F.col("_row") == place, F.col("_v")))
    picked = ordered.groupBy(*keys).agg(
        *[value(F.floor(c)).alias(f"_a{k}") for k, c in enumerate(at.values())],
        *[value(F.ceil(c)).alias(f"_z{k}") for k, c in enumerate(at.values())], F.max("_n").alias("_n"))
    return picked.select(*keys, *[
        (F.col(f"_a{k}") + (F.col(f"_z{k}") - F.col(f"_a{k}")) * (c - F.floor(c))).alias(name) for k, (name, c) in enumerate(at.items())])


def _bracketed(rows: DataFrame, keys: list[str], wanted: dict[str, float], rank: str) -> DataFrame:
    """Percentiles of long groups: only the values between two marks of a sketch are ordered."""
    names, shares = list(wanted), list(wanted.values())
    margin = 2.0 / ACCURACY
    marks = [max(p - margin, 0.0) for p in shares] + [min(p + margin, 1.0) for p in shares]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", marks, ACCURACY).alias("_marks"),
    )
    brackets = F.array(*[
        F.struct(
            F.lit(k).alias("_k"),
            F.col("_marks")[k].alias("_low"),
            F.col("_marks")[k + len(shares)].alias("_high"),
            _position(p, rank).alias("_rank"),
        )
        for k, p in enumerate(shares)
    ])
    plan = few(sketch.select(*keys, brackets.alias("_b")), FEW_GROUPS)
    inside = (
        rows.join(plan, keys).select(*keys, "_v", F.inline("_b"))
        .filter(F.col("_v") <= F.col("_high"))
        # Everything below the bracket becomes one counted row.
        .groupBy(*keys, "_k", "_rank", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    order = W.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first())
    ranked = inside.withColumn("_upto", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    floor, ceiling = F.floor("_rank"), F.ceil("_rank")
    picked = ranked.groupBy(*keys, "_k").agg(
        F.min(F.when(F.col("_upto") > floor, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > ceiling, F.col("_v"))).alias("_z"),
        F.max(F.col("_rank") - floor).alias("_f"),
    )
    result = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_k") == k, result)).alias(name) for k, name in enumerate(names)]
    )


def robust_sigma(df: DataFrame, keys: list[str], value: str, out: str = "sigma") -> DataFrame:
    """1.4826 x the median absolute deviation from the median, per key."""
    middle = cut(exact_percentiles(df, keys, value, {"_median": 0.5}))
    spread = df.join(middle, keys).withColumn("_gap", F.abs(F.col(value) - F.col("_median")))
    return exact_percentiles(spread, keys, "_gap", {"_mad": 0.5}).select(
        *keys, (1.4826 * F.col("_mad")).alias(out)
    )
