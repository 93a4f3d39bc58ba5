"""Near duplicates by an inverted join over MinHash coordinates.

Documents with equal shingle sets form one class. Every class is posted under the first
COORDINATES - MATCHES + 1 (coordinate, value) pairs of its signature: classes that agree in at
least MATCHES coordinates share one of these. Tasks over posting lists count the agreeing
coordinates of the classes in a list, look at a pair only in the first list it shares, and keep
spanning links instead of all pairs. The groups so found hold every pair that can be similar; their
full shingle sets are then compared, block against block, and the confirmed links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import settled
from scanweave.operators.graph import stars

COORDINATES = 32
#: A pair of similarity 0.8 agrees in fewer than 14 of 32 coordinates once in a million.
MATCHES = 14
PREFIX = COORDINATES - MATCHES + 1
LIST_BLOCK = 1_024
SET_BLOCK = 512
BUCKET_ROWS = 8_000
SET_ROWS = 2_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(17).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = np.random.default_rng(23).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = total + h[i:len(h) - width + 1 + i] * _ODD[i]
    return np.unique(_mix(total))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest turned hash of the set for each coordinate, as 32 bits."""
    low = np.full(COORDINATES, 2**32 - 1, dtype=np.uint64)
    for start in range(0, len(found), 4_096):
        part = found[None, start:start + 4_096] * _TURN[0][:, None] + _TURN[1][:, None]
        low = np.minimum(low, (part >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint32)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for links `a`-`b` among `n` nodes."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        differ = lo != hi
        a, b, lo, hi = a[differ], b[differ], lo[differ], hi[differ]
        np.minimum.at(root, hi, lo)
        while not np.array_equal(root[root], root):
            root = root[root]
    return root


def _agreeing(coordinate: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one posting list that agree often enough and met at no earlier coordinate."""
    left, right = [], []
    for start in range(0, len(values), 128):
        equal = values[start:start + 128, None, :] == values[None, :, :]
        enough = (equal.sum(axis=2) >= MATCHES) & ~equal[:, :, :coordinate].any(axis=2)
        i, j = np.nonzero(enough)
        left.append(i + start)
        right.append(j)
    left, right = np.concatenate(left), np.concatenate(right)
    return left[left < right], right[left < right]


def _links(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = roots(len(ids), a, b)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[moved], ids[root[moved]]], axis=1)


def _frame(pairs: list[np.ndarray]) -> pd.DataFrame:
    found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _collisions(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["token", "pair", "rep"], ignore_index=True)
    values = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), COORDINATES)
    ids, token, pair = frame["rep"].to_numpy(), frame["token"].to_numpy(), frame["pair"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1]), True])
    small = np.diff(starts) == 2
    first = starts[:-1][small]
    equal = values[first] == values[first + 1]
    earlier = np.arange(COORDINATES)[None, :] < (token[first] >> 32)[:, None]
    hit = first[(equal.sum(axis=1) >= MATCHES) & ~(equal & earlier).any(axis=1)]
    pairs = [np.stack([ids[hit + 1], ids[hit]], axis=1)]
    for s, e in zip(starts[:-1][~small], starts[1:][~small]):
        if e - s > 2:
            pairs.append(_links(ids[s:e], *_agreeing(int(token[s] >> 32), values[s:e])))
    return _frame(pairs)


def _confirmed(percent: int):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        for _, group in frame.groupby(["cluster", "pair"]):
            sets = [np.asarray(s, dtype=np.int64) for s in group["found"]]
            ids, sizes = group["rep"].to_numpy(), np.array([len(s) for s in sets])
            row = np.repeat(np.arange(len(sets)), sizes)
            _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = often[column] > 1
            row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
            common = np.zeros((len(sets), len(sets)), dtype=np.float64)
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            width = int(column[-1]) + 1 if len(column) else 0
            for start in range(0, width, 4_096):
                lo, hi = np.searchsorted(column, [start, start + 4_096])
                part = np.zeros((len(sets), min(4_096, width - start)), dtype=np.float32)
                part[row[lo:hi], column[lo:hi] - start] = 1
                common += part @ part.T
            a, b = np.nonzero(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
            pairs.append(_links(ids, a[a < b], b[a < b]))
        return _frame(pairs)

    return compare


def _paired(rows: DataFrame, blocks, by: str) -> DataFrame:
    """Rows of `by` with the pairs of blocks they belong to; one block means one pair."""
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    pair = F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")
    return rows.withColumn("pair", pair.cast("long")).drop("_blocks", "_own", "_other")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for every row of `docs`.

    Documents are linked when their sets of `words`-word shingles (case of A-Z ignored) have a
    Jaccard similarity of at least `percent` / 100; components are named by their smallest doc_id,
    which is kept. Texts that are null or hold no words have no shingles and stand alone, as do
    classes of rows that all lack an id: their component is the row's own id, and they are kept.
    Rows with the same id and different texts are judged each by its text. text_hash (xxhash64 of
    the text) tells such rows apart. An empty table gives no rows.
    """
    return _judged(docs, words, percent).drop("root")


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of `near_duplicates` with `root`, which tells components of the same smallest id apart."""
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets],
                "key": [set_key(s) if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets]})

    rows = settled(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
        signed, "doc_id long, text_hash long, n_shingles long, key binary, sig binary"))
    classes = settled(rows.filter("key is not null and doc_id is not null").groupBy("key")
                      .agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sig").alias("sig"))
                      .select("key", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("text_hash"), "sig"))
    # Classes that share their smallest id (one id, several texts) need names of their own.
    classes = _unique_names(classes)

    posted = settled(classes.select("rep", F.explode(_values()).alias("token")))
    crowded = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    met = posted.join(crowded, "token").join(classes.select("rep", "sig"), "rep")
    met = _paired(met, F.ceil(F.col("n") / LIST_BLOCK), "token").drop("n")
    met = settled(met)
    buckets = max(1, -(-met.count() // BUCKET_ROWS))
    near = (met.withColumn("_bucket", F.pmod(F.xxhash64("token", "pair"), F.lit(buckets))).groupBy("_bucket")
            .applyInPandas(_collisions, "a long, b long"))
    clusters = settled(stars(settled(near.distinct()).withColumn("scan_id", F.lit("d"))).select(F.col("a").alias("rep"), F.col("b").alias("cluster")))
    members = clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct())
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    members = settled(members.join(sizes, "cluster").join(classes.select("rep", "key", "doc_id", "text_hash"), "rep"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                sets = [shingles(t, words).view(np.int64) for t in part["text"]]
                yield part.drop(columns="text").assign(found=sets)

    # Merged at every size: texts meet their groups by the same plan on small and large tables.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(members.hint("merge"), ["doc_id", "text_hash"])
    full = (texts.dropDuplicates(["rep"]).select("rep", "cluster", "n", "text")
            .mapInPandas(again, "rep long, cluster long, n long, found array<long>"))
    full = _paired(full, F.ceil(F.col("n") / SET_BLOCK), "cluster")
    # Groups of one block share buckets; a pair of blocks of a larger group is a task's whole share.
    single = F.col("n") <= SET_BLOCK
    buckets = max(1, -(-members.filter(single).count() // SET_ROWS))
    full = full.withColumns({"_bucket": F.when(single, F.pmod(F.xxhash64("cluster"), F.lit(buckets))),
                             "_group": F.when(~single, F.col("cluster")), "_pair": F.when(~single, F.col("pair"))}).drop("n")
    exact = full.groupBy("_bucket", "_group", "_pair").applyInPandas(_confirmed(percent), "a long, b long")
    linked = stars(settled(exact.distinct()).withColumn("scan_id", F.lit("d"))).select(F.col("a").alias("rep"), F.col("b").alias("root"))
    names = classes.select("key", "rep", "doc_id").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = names.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = settled(names.join(least, "root").select("key", "root", "component_id"))
    # A document of the class is named even if its own id is null.
    out = rows.select("doc_id", "text_hash", "n_shingles", "key").join(found, "key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "root")


def _values():
    """(coordinate, value) pairs of the prefix as numbers."""
    def token(i):
        four = F.substring(F.col("sig"), i * 4 + 1, F.lit(4))
        return (i.cast("long") * F.lit(1 << 32)) + F.conv(F.hex(four), 16, 10).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(PREFIX - 1)), token)


def _unique_names(classes: DataFrame) -> DataFrame:
    """`rep` is the smallest id; further classes of that id get negative names from their keys."""
    twice = settled(classes.groupBy("rep").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1"))
    if twice.isEmpty():
        return classes.withColumn("doc_id", F.col("rep"))
    marked = classes.withColumn("doc_id", F.col("rep")).join(twice.drop("n"), "rep", "left")
    other = -F.abs(F.xxhash64("key")) - 1
    return settled(marked.withColumn("rep", F.when(F.col("first").isNull() | (F.col("first") == F.col("key")), F.col("rep")).otherwise(other)).drop("first"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs`, all columns, of each component of `near_duplicates`.

    Of several kept texts of one component, under one id, the one with the smallest hash stays.
    Rows equal in id (null or not) and text count as one; rows that stand alone stay.
    """
    def keys(hashed: str) -> list[Column]:
        return [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col(hashed).alias("_hash")]

    judged = settled(_judged(docs, words, percent).select(*keys("text_hash"), "kept", "root").distinct())
    several = (judged.filter("kept AND root IS NOT NULL").groupBy("root").agg(F.min("_hash").alias("_first"), F.max("_hash").alias("_last"))
               .filter("_first <> _last"))
    more = judged.filter("kept").join(several, "root").filter("_hash <> _first")
    named = ["_id", "_none", "_hash"]
    gone = settled(judged.filter(~F.col("kept")).select(named).unionByName(more.select(named)))
    rows = docs.withColumn("_text", F.xxhash64("text")).select(*docs.columns, *keys("_text"))
    return rows.join(gone.hint("merge"), named, "left_anti").dropDuplicates(named).select(*docs.columns)
