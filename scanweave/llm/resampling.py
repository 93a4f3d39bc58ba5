"""Resampling documents towards a target by hashed-feature importance.

Features are runs of consecutive words, hashed by crc32 into buckets. The checksum is linear: a byte
contributes a value that depends only on the byte and on its distance from the end of the feature,
and every length adds a constant. So a table by distance and byte is made once, the contributions of
all features of a batch are looked up together, and `bitwise_xor.reduceat` sums them span by span.
Spans longer than the table are summed in blocks, and the blocks are folded in pairs: the left one is
moved past the right one by the same table.

A bucket's gain is its log frequency in the target over that in the documents; a document's weight
is the mean gain of its features. Hashed Gumbel noise on the weights makes the highest scores a
weighted draw without replacement, the same on every run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import flat_bytes, settled, shard_count

BUCKETS = 10_000
RUN = 1
MIN_WORDS = 20
SHARE = (10, 100)
SEED = 2024
#: Bytes a span may have before it is folded from blocks of as many.
BLOCK = 64
#: Bytes that are hashed at once; a longer span is folded from such parts.
PART = 1 << 20
RANGE_ROWS = 100_000

#: A-Z become a-z; digits, letters and bytes of other characters make words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _table(distances: int) -> np.ndarray:
    """Contribution of a byte (column) that stands `row` bytes before the end."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, np.uint32(0xEDB88320) ^ (one >> 1), one >> 1)
    rows = [one]
    for _ in range(distances - 1):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 255])
    return np.stack(rows)


_TABLE = _table(BLOCK)
#: What the length alone contributes: the checksum of so many zero bytes.
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], dtype=np.uint32)


def _moves(levels: int) -> list[np.ndarray]:
    """For 1, 2, 4 … blocks: tables by byte of a value that is moved so many blocks further from the end."""
    moves = [np.stack([_TABLE[BLOCK - 1 - byte] for byte in range(4)])]
    while len(moves) < levels:
        moves.append(_move(moves[-1], moves[-1]))
    return moves


def _move(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    return table[0][value & 255] ^ table[1][value >> 8 & 255] ^ table[2][value >> 16 & 255] ^ table[3][value >> 24]


_MOVES = _moves(34)


def _summed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the contributions of spans of 1 to BLOCK bytes."""
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    distance = np.repeat(lengths, lengths) - 1 - within
    return np.bitwise_xor.reduceat(_TABLE[distance, data[np.repeat(starts, lengths) + within]], first)


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of spans of up to PART bytes: blocks from the end backwards, folded in pairs."""
    out = np.zeros(len(starts), dtype=np.uint32)
    blocks = -(-lengths // BLOCK)
    levels = np.ceil(np.log2(blocks)).astype(int)
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        count = blocks[rows]
        row = np.repeat(np.arange(len(rows)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        left = count[row] - 1 - place  # blocks still to come
        end = (starts[rows] + lengths[rows])[row] - left * BLOCK
        start = np.maximum(starts[rows][row], end - BLOCK)
        # Missing blocks on the left count as zero bytes, which contribute nothing.
        sums = np.zeros((len(rows), 1 << level), dtype=np.uint32)
        sums[row, (1 << level) - 1 - left] = _summed(data, start, end - start)
        for step in range(level):
            sums = _move(_MOVES[step], sums[:, 0::2]) ^ sums[:, 1::2]
        out[rows] = sums[:, 0]
    return out


def _length_constant(lengths: np.ndarray) -> np.ndarray:
    out = _LENGTH[np.minimum(lengths, BLOCK)]
    for n in np.unique(lengths[lengths > BLOCK]):
        # The checksum of n zero bytes is that of the remainder, moved on; both register inversions are in _LENGTH.
        value, steps, level = ~_LENGTH[n % BLOCK:n % BLOCK + 1], int(n) // BLOCK, 0
        while steps:
            if steps & 1:
                value = _move(_MOVES[level], value)
            steps >>= 1
            level += 1
        out[lengths == n] = ~value
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of every span; spans may overlap and have any length."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
    if len(short):
        out[short] = _summed(data, starts[short], lengths[short])
    rest = np.flatnonzero(lengths > BLOCK)
    # Long spans are taken in parts, so that memory follows the part and not the span.
    middle = rest[lengths[rest] <= PART]
    for some in np.split(middle, np.flatnonzero(np.diff(np.cumsum(lengths[middle]) // PART)) + 1):
        if len(some):
            out[some] = _folded(data, starts[some], lengths[some])
    for i in rest[lengths[rest] > PART]:
        at = int(starts[i] + lengths[i] % PART)
        value = _folded(data, starts[i:i + 1], np.array([at - starts[i]])) if at > starts[i] else np.zeros(1, np.uint32)
        while at < ends[i]:
            value = _move(_MOVES[(PART // BLOCK).bit_length() - 1], value) ^ _folded(data, np.array([at]), np.array([PART]))
            at += PART
        out[i] = value[0]
    return out ^ _length_constant(lengths)


def word_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased `data`; no word passes one of the `breaks`."""
    inside = _IN_WORD[data]
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    at = breaks[(breaks > 0) & (breaks < len(data))]
    before[at] = False
    after[at - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _pieces(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PART bytes that end at a document's end or between words."""
    at, ends = 0, places[1:]
    while at < len(data):
        stop = min(at + PART, len(data))
        while stop < len(data) and _IN_WORD[data[stop]] and _IN_WORD[data[stop - 1]] and ends[np.searchsorted(ends, stop)] != stop:
            stop += 1
        yield at, stop
        at = stop


def hashed_features(flat: np.ndarray, places: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket) of the features that end in each piece, and the document of each word in it.

    Features are all runs of 1 to `run` words of a document, joined by one space.
    """
    data = _LOWER[flat]
    last_doc, last = np.zeros(0, np.int64), []
    for lo, hi in _pieces(data, places):
        part = data[lo:hi]
        starts, ends = word_spans(part, places - lo)
        if not len(starts):
            continue
        docs = np.searchsorted(places, starts + lo, side="right") - 1
        if run == 1:
            yield docs, span_crcs(part, starts, ends).astype(np.int64) % buckets, docs
            continue
        # Words side by side with one space between; the words before the piece stand in front.
        carried = len(last)
        lengths = np.r_[np.array([len(w) for w in last], dtype=np.int64), ends - starts]
        every = np.r_[last_doc, docs]
        tops = np.cumsum(lengths + 1) - 1
        line = np.full(int(tops[-1]) + 1, 32, dtype=np.uint8)
        if carried:
            line[:tops[carried - 1]] = np.frombuffer(b" ".join(last), dtype=np.uint8)
        size = ends - starts
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(tops[carried:] - size, size) + within] = part[np.repeat(starts, size) + within]
        found_docs, found = [], []
        for words in range(1, run + 1):
            ending = np.arange(max(carried, words - 1), len(every))
            ending = ending[every[ending - words + 1] == every[ending]]
            found_docs.append(every[ending])
            first = ending - words + 1
            found.append(span_crcs(line, tops[first] - lengths[first], tops[ending]).astype(np.int64) % buckets)
        yield np.concatenate(found_docs), np.concatenate(found), docs
        keep = slice(max(0, len(every) - run + 1), None)
        last_doc = every[keep]
        last = [line[t - n:t].tobytes() for t, n in zip(tops[keep], lengths[keep])]


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all `texts(text)` fall into each bucket. At most `buckets` rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in hashed_features(*flat_bytes(batch.column(0)), run, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's smoothed share of the target over its share of the documents."""
    buckets, all_s, all_t = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + buckets) / ((float(s) + 1) * (all_t + buckets))))
                     for s, t in zip(documents, target)], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain, 0 without features) of every row."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for doc, bucket, word_doc in hashed_features(*flat_bytes(batch.column(1)), run, len(gain)):
                words += np.bincount(word_doc, minlength=n)
                features += np.bincount(doc, minlength=n)
                # Sums of at most PART small whole numbers are exact in doubles.
                total += np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Thousandths of Gumbel noise, fixed by seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def _cutoff(scores: DataFrame, draws: int) -> int:
    """The score of place `draws`, read from counts of whole thousands and then of one thousand (bounded by the range of scores)."""
    above = 0
    for row in sorted(scores.groupBy(F.floor(F.col("score") / 1000).alias("k")).count().collect(), reverse=True):
        if above + row["count"] >= draws:
            for one in sorted(scores.filter(F.floor(F.col("score") / 1000) == row["k"]).groupBy("score").count().collect(), reverse=True):
                above += one["count"]
                if above >= draws:
                    return one["score"]
        above += row["count"]
    raise ValueError("fewer rows than draws")


def ranked(rows: DataFrame) -> DataFrame:
    """`rank` from 1 by descending score, then doc_id (null last), over all rows: sorted in ranges, numbered by range."""
    parts = shard_count(rows.count(), RANGE_ROWS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")]
    dealt = (rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .withColumns({"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    dealt = settled(dealt)
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    first = np.cumsum([0] + [n for _, n in sizes])
    starts = dealt.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, first)], "_part int, _first long")
    return dealt.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_first") + F.col("_local") + 1).drop("_part", "_first", "_local", "_row")


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs(doc_id, text)`; `target(text)` gives the aim.

    Of the rows with at least `min_words` words, the floor(share) highest scores are drawn and ranked
    from 1, ties to the smaller doc_id; other rows have a null rank. Null and empty texts have no
    features and weight 0; a null doc_id counts as the empty text in the noise and comes last among
    equal scores; repeated rows are rows of their own, numbered in any order; an empty target or an
    empty table needs no special case.
    """
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    scored = settled(weighted(docs, gain, run).withColumn("score", F.col("weight") + noise(seed)))
    long_enough = scored.filter(F.col("n_words") >= min_words)
    draws = long_enough.count() * share[0] // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & (F.col("score") >= _cutoff(long_enough, draws))
    first = ranked(scored.filter(drawn).select(*columns))
    first = first.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return first.select(*columns, "rank").unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
