"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition holds one sum per shard. The two with the largest spread are combined in
opposite order, largest with smallest, until one is left. Groups are dealt into hashed buckets of
bounded size; every bucket is differenced in its task, and what a bucket leaves is again a partial
partition, so buckets of buckets are combined the same way until one remains.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import number_within, settled

BUCKET_GROUPS = 2_048
FAN_IN = 512


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions (rows of `k` sums): the final shard of every row's every slot.

    Ties go to the earlier row. Shard 0 ends with the largest sum.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    heap, nodes = [], []
    for i in range(n):
        sums = [int(v) for v in parts[i][order[i]]]
        nodes.append(None)
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right))]
        turn = sorted(range(k), key=lambda s: -sums[s])
        sums = [sums[s] for s in turn]
        nodes.append((a, b, turn))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    shard = np.empty((n, k), dtype=np.int32)
    todo = [(len(nodes) - 1, list(range(k)))] if n else []
    while todo:
        node, into = todo.pop()
        if nodes[node] is None:
            shard[node, order[node]] = into
            continue
        a, b, turn = nodes[node]
        left, right = [0] * k, [0] * k
        for place, s in enumerate(turn):
            left[s] = into[place]
            right[k - 1 - s] = into[place]
        todo += [(a, left), (b, right)]
    return shard


def balanced_groups(groups: DataFrame, shards: int) -> DataFrame:
    """`groups(key, weight)` with the `shard` of each, sums of weights near equal. Keys are unique."""
    count = groups.count()
    buckets = max(1, -(-count // BUCKET_GROUPS))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "key"], ascending=[False, True], ignore_index=True)
        parts = np.zeros((len(frame), shards), dtype=np.int64)
        parts[:, 0] = frame["weight"]
        frame["slot"] = difference(parts)[:, 0]
        return frame[["key", "weight", "node", "slot"]]

    def later(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, row = np.unique(frame["node"], return_inverse=True)
        parts = np.zeros((len(nodes), shards), dtype=np.int64)
        parts[row, frame["slot"]] = frame["weight"]
        found = difference(parts)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "slot": np.tile(np.arange(shards, dtype=np.int32), len(nodes)),
                             "up": int(frame["up"].iloc[0]), "up_slot": found.ravel()})

    placed = settled(
        groups.select("key", "weight", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("node"))
        .groupBy("node").applyInPandas(first, "key string, weight long, node long, slot int"))
    level = placed.groupBy("node", "slot").agg(F.sum("weight").alias("weight"))
    rows = placed
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        level = settled(level.withColumn("up", F.floor(F.col("node") / FAN_IN)))
        step = settled(level.groupBy("up").applyInPandas(later, "node long, slot int, up long, up_slot int"))
        level = (level.drop("up").join(step, ["node", "slot"])
                 .groupBy(F.col("up").alias("node"), F.col("up_slot").alias("slot")).agg(F.sum("weight").alias("weight")))
        rows = (rows.join(step, ["node", "slot"])
                .select("key", F.col("up").alias("node"), F.col("up_slot").alias("slot")))
    return rows.select("key", F.col("slot").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard; documents of equal text stay together, bytes are near equal.

    Size is the UTF-8 length of the text plus 1. Returns doc_id, size, text_crc32, shard and slot
    (gapless from 0 within the shard). A null text is an empty one and shares its group. Repeated
    rows and null ids are rows like any other; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settled(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("key")))
    groups = settled(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    shard = balanced_groups(groups, shards)
    placed = settled(rows.join(shard, "key").drop("key"))
    return number_within(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
