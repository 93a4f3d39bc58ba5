"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanweave.session import checkpoint_root, cut, prepare

CHUNK_ROWS = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """`cut(df)`, after which Spark may drop the shuffle files that led to it.

    Spark removes them once the driver's JVM has collected the plans that own them, so a
    collection is asked for here: a long job then holds one step's files at a time.
    """
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Remove settled tables that no later step reads; their successors are written tables themselves."""
    for df in tables:
        spark = df.sparkSession
        root = checkpoint_root(spark)
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("cut-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder.rsplit('/', 1)[-1]}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def number_within(rows: DataFrame, keys: list[str], order: list[str], out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of every key from 0, without a key's rows meeting in one task.

    Rows are dealt into hashed chunks of about `chunk_rows`; the running totals over the chunk
    counts of a key give each chunk its first number. `rows` should be a written table, because
    it is read more than once. Equal rows are numbered in any order.
    """
    chunks = max(1, -(-rows.count() // chunk_rows))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = (dealt.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
              .select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_first")))
    local = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return (dealt.withColumn("_local", local).join(starts, [*keys, "_chunk"])
            .withColumn(out, (F.col("_first") + F.col("_local")).cast("long"))
            .drop("_chunk", "_first", "_local"))


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of every key with their `rank` from 1; limits are taken before the shuffle too."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def smallest_ids(rows: DataFrame, vector: str, keep: int) -> DataFrame:
    """At most `keep` rows of every distinct vector, those with the smallest ids.

    Exact for searches with ties to the smaller id: a further copy never enters a list of
    `keep - 1` rows besides the query itself.
    """
    copy = F.row_number().over(W.partitionBy(vector).orderBy("vec_id"))
    return rows.withColumn("_copy", copy).filter(F.col("_copy") <= keep).drop("_copy")


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def every(count: int) -> Column:
    """One row for each number below `count`: sends a block to all partner blocks."""
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow column of texts as one array, and where each row begins (one place more than rows); nulls are empty."""
    import pyarrow as pa

    held = column.cast(pa.large_binary())
    if held.null_count:
        held = held.fill_null(b"")
    places = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset:held.offset + len(held) + 1]
    data = held.buffers()[2]
    flat = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return flat[places[0]:places[-1]], places - places[0]
