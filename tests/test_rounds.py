"""Rounds that leave their long side in place, and percentiles of many short groups."""

import random

import pytest
from pyspark.sql import functions as F

from scanweave.operators import quantiles
from scanweave.plans import fits as ft
from scanweave.session import cut, held, prepare


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def merged(spark):
    """No broadcasts, as with tables of a size."""
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    prepare(spark)


def region(rows, labels=6):
    return rows.select(F.lit("s").alias("scan_id"), (F.col("id") % labels).cast("int").alias("label"), *[F.rand(k).alias(c) for k, c in enumerate("xyz")])


def test_held_side_is_not_moved_again(merged):
    points = held(cut(region(merged.range(2000))), *ft.KEY)
    fits = cut(points.select(*ft.KEY).distinct().withColumn("kind", F.lit("plane")))
    plan = final_plan(ft.meeting(points, None, fits).groupBy(*ft.FIT).agg(F.count("*").alias("n")))
    # Only the fits are moved, as the final and the initial plan say.
    assert plan.count("ENSURE_REQUIREMENTS") == 2
    points.unpersist()


def test_large_regions_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(ft, "CHUNK_POINTS", 100)
    rows = cut(region(spark.range(1010).withColumn("id", F.when(F.col("id") < 1000, 0).otherwise(1))))
    points, large = ft.held_regions(rows)
    assert [(r.label, r.chunks) for r in large.collect()] == [(0, 10)]
    assert points.filter("label = 0").select("chunk").distinct().count() == 10
    fits = spark.createDataFrame([("s", 0, "plane"), ("s", 0, "sphere"), ("s", 1, "plane")], "scan_id string, label int, kind string")
    got = ft.meeting(points, large, fits).groupBy(*ft.FIT).agg(F.count("*").alias("n"))
    assert {(r.label, r.kind): r.n for r in got.collect()} == {(0, "plane"): 1000, (0, "sphere"): 1000, (1, "plane"): 10}


def test_short_groups_take_one_shuffle(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(40), draw.choice([None, float("nan"), -0.0, draw.random(), draw.random()])) for _ in range(2000)]
    df = cut(spark.createDataFrame(rows, "scan_id string, label int, v double"))
    wanted = {"low": 0.05, "middle": 0.5, "high": 0.95}
    monkeypatch.setattr(quantiles, "_bracketed", lambda *_: pytest.fail("no group is long"))
    got = quantiles.exact_percentiles(df, ["scan_id", "label"], "v", wanted)
    assert final_plan(got).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    groups = {}
    for scan, label, v in rows:
        if scan is not None and v is not None and v == v:
            groups.setdefault((scan, label), []).append(v)
    found = {(r.scan_id, r.label): r for r in got.collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        values.sort()
        for name, p in wanted.items():
            at = (len(values) - 1) * p
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert found[key][name] == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-12)


def test_short_and_long_groups_together(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 500)
    rows = spark.range(1100).select(F.when(F.col("id") < 1000, "long").otherwise("short").alias("scan_id"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = {r.scan_id: r.m for r in quantiles.exact_percentiles(cut(rows), ["scan_id"], "v", {"m": 0.5}).collect()}
    values = sorted(float(i * 7919 % 1009) for i in range(1000)), sorted(float(i * 7919 % 1009) for i in range(1000, 1100))
    assert got == {"long": (values[0][499] + values[0][500]) / 2, "short": (values[1][49] + values[1][50]) / 2}
