"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


# Fixed values.
STATIC_BROADCAST = "64KB"
MEASURED_BROADCAST = "10MB"
FEW_ROWS = 400_000
HELD_ROWS = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the plans rely on (all may be changed per session)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", MEASURED_BROADCAST)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Hot nodes of a star-shaped graph skew one join key; splitting it is worth a shuffle.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def prepare_scans(spark: SparkSession) -> SparkSession:
    """The settings of the scan queries: only small files and measured sizes make a broadcast.

    Before a job runs, Spark knows the file sizes only: rows that an explode adds and rows
    that compress well do not count, so a table of millions of rows can look small. After a
    shuffle its true size is known.
    """
    prepare(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", STATIC_BROADCAST)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED_BROADCAST)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: `spark.checkpoint.dir` as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="scanweave-")
    return _LOCAL_DIRS[app]


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    A written table survives lost executors and, unlike a cached plan, gives the
    optimizer true sizes, so later joins broadcast only what is really small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """`cut(df)` and how many of its rows meet the condition, counted while they are written."""
    told = Observation()
    out = cut(df.observe(told, F.count_if(condition).alias("n")))
    return out, told.get["n"]


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """`df` dealt out by `keys`, about `rows` rows a task: a short table of which every row becomes
    many would otherwise be one file and one task."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """`cut(df)` for a table that is nearly always short (a row per scan or part): sent to every
    task when it has at most `rows` rows, so the long side of the join stays in place."""
    told = Observation()
    out = cut(df.observe(told, F.count(F.lit(1)).alias("n")))
    return F.broadcast(out) if told.get["n"] <= rows else out


def held(df: DataFrame, *keys: str, rows: int = HELD_ROWS) -> DataFrame:
    """`df` hashed and sorted by `keys` once and kept on the executors' disks: every round that joins
    it by `keys` moves the other side only. To be given back by `unpersist()`; lost parts are dealt anew."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    kept = df.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    kept.count()  # its partitioning is known to later plans once it is there
    return kept


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 1) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by `keys`, joined to at least `rows` rows so that no group lies in two of them."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        if size + len(b) >= rows:
            other = (b[keys] != b[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
            end = other[-1] + 1 if len(other) else 0
            if end or held and (held[-1][keys].iloc[-1] != b[keys].iloc[0]).any():
                yield pd.concat([*held, b.iloc[:end]], ignore_index=True)
                held, size, b = [], 0, b.iloc[end:]
        held.append(b)
        size += len(b)
    if held:
        yield pd.concat(held, ignore_index=True)
