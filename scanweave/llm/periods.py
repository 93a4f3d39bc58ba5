"""Periodic runs of words, found from Lyndon roots.

A run is a stretch of words that repeats with a smallest period and cannot be extended. Every run
has a Lyndon root under one of two opposite orders of the words, and the grouping phase of Baier's
suffix sorter yields, for each place, the longest Lyndon word that starts there: groups of suffixes
are taken from the greatest down, and a group is appended to the nearest smaller suffix before each
of its members. Both orders are grouped; roots that follow each other at their own length are
extended in both directions as far as the words agree (longest common extension).

Stretches that cannot hold a run of the wanted number of periods are passed over first: inside a run,
every word but those of the last period comes again within one period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = 4
MIN_LENGTH = 6
#: Words whose stretches are looked at together; a longer text is a part of its own.
PART_WORDS = 500_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by Baier's grouping; the end is smaller than any rank."""
    n = len(ranks)
    number = {rank: g for g, rank in enumerate(sorted(set(ranks)))}
    group = [number[rank] for rank in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    # Places of suffixes whose group is still to come, linked both ways.
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    at = len(members) - 1
    while at >= 0:
        size, copies, last = length[at], [], -1
        for i in members[at]:
            if group[i] != at:
                continue  # moved to a greater group since
            out[i] = size
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                if before == last:
                    copies[-1][0] += 1
                else:
                    copies.append([1, before])
                    last = before
        split: dict[tuple[int, int], list[int]] = {}
        for times, before in copies:
            split.setdefault((times, group[before]), []).append(before)
        # More copies of the greater group make a greater suffix: each new group goes directly above its old one.
        for times, old in sorted(split, reverse=True):
            moved, new, top = split[times, old], len(members), above[old]
            members.append(moved)
            length.append(length[old] + times * size)
            for i in moved:
                group[i] = new
            above.append(top)
            below.append(old)
            above[old] = new
            if top >= 0:
                below[top] = new
        at = below[at]
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree; steps double, so the cost follows the answer."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at:min(at + step, n)] != b[at:min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def stretches(words: np.ndarray, doc: np.ndarray, doc_end: np.ndarray, periods: int, min_length: int) -> list[tuple[int, int]]:
    """Ranges outside of which no run lies, none of them across documents.

    A run of period q has at least (periods - 1) q places in a row whose word comes again within q;
    this is looked for at each power of two up to q.
    """
    n = len(words)
    key = doc * (int(words.max()) + 1 if n else 1) + words
    order = np.argsort(key, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    gap[order[same]] = order[same + 1] - order[same]
    longest = int(np.bincount(doc).max()) if n else 0
    found, low = [], 1
    while periods * low <= longest:
        close = np.zeros(n + 2, dtype=np.int8)
        close[1:-1] = gap < 2 * low
        edges = np.flatnonzero(np.diff(close))
        start, stop = edges[::2], edges[1::2]
        held = stop - start >= max((periods - 1) * low, min_length - 2 * low + 1)
        start, stop = start[held], stop[held]
        if len(start):
            found.append(np.stack([start, np.minimum(stop + 2 * low - 1, doc_end[start])], axis=1))
        low *= 2
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(map(tuple, np.concatenate(found).tolist())) if found else []:
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def runs_in(words: np.ndarray, start: int, stop: int, low: int, high: int, periods: int, min_length: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of the document `words[low:high]` that lie in start..stop."""
    found, part = set(), words[start:stop]
    for ranks in (part.tolist(), (-part).tolist()):
        lyndon = np.array(lyndon_lengths(ranks), dtype=np.int64)
        root = np.arange(len(part))
        held = root + (periods - 1) * lyndon <= len(part)
        root = root[held]
        # A run of so many periods holds one root less in a row, whatever its first place.
        for k in range(1, periods - 1):
            root = root[lyndon[root + k * lyndon[root]] == lyndon[root]]
        after = root + lyndon[root]
        root = root[(after < len(part)) & (part[root] == part[np.minimum(after, len(part) - 1)])]
        reached: dict[int, int] = {}
        for i, period in zip((root + start).tolist(), lyndon[root].tolist()):
            if i + period <= reached.get(period, -1):
                continue  # a later root of a run already extended
            end = i + period + common_length(words[i:high], words[i + period:high])
            begin = i - common_length(words[low:i][::-1], words[low:i + period][::-1])
            reached[period] = end
            if end - begin >= max(min_length, periods * period):
                found.add((begin - low, end - begin, period))
    return found


def document_runs(words: np.ndarray, ends: np.ndarray, periods: int = PERIODS, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of each document by start, then period; `ends` are the places after the documents' last words."""
    low = np.r_[0, ends[:-1]].astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - low)
    found: list[set] = [set() for _ in ends]
    for start, stop in stretches(words, doc, np.repeat(ends, ends - low), periods, min_length):
        d = int(doc[start])
        found[d] |= runs_in(words, start, stop, int(low[d]), int(ends[d]), periods, min_length)
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that any run holds after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame, periods: int = PERIODS, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words) and collapsed text of every row of `docs(doc_id, text)`.

    Words are what white space (space, tab to carriage return) separates. Runs have at least `periods`
    (two or more) whole periods and `min_length` words. Null and empty texts have no words, no runs
    and an empty collapsed text; null ids and repeated rows are kept as they are; an empty table gives
    no rows. A text is one task's work, whatever its length.
    """
    if periods < 2:
        raise ValueError("a run has two periods or more")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                first, texts, ids, ends = at, [], [], []
                while at < batch.num_rows and len(ids) < PART_WORDS:
                    words = (batch.column(1)[at].as_py() or b"").split()
                    texts.append(words)
                    ids.extend(map(number.__getitem__, words))
                    ends.append(len(ids))
                    at += 1
                runs = document_runs(np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64), periods, min_length)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], _RUN_TYPE),
                    pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).view(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(search, f"doc_id long, n_words long, runs {RUNS}, collapsed string"))


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of `find_runs`: doc_id, n_runs, the run of most periods, and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast(RUNS[len("array<"):-1])
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate("runs", none, lambda a, x: F.when(
        a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and the words of each text joined by one space; a tenth of the ids get a periodic end.

    With h the crc32 of the id in decimal and n words: where h % 10 is 0, words from a = (h / 10) % n on
    repeat the p = 1 + (n - a) / (3 + (h / 10) % 8) words that start at a.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", words.alias("_words"), h.alias("_h")).withColumns(
        {"_n": F.size("_words").cast("long"), "_g": F.expr("_h div 10")})
    changed = (F.col("_h") % 10 == 0) & (F.col("_n") > 0)
    # No start (null) for the other rows, so the formulas below see only rows with words.
    rows = rows.withColumn("_a", F.when(changed, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    turned = F.expr("transform(sequence(0L, _n - 1), i -> _words[CAST(IF(i < _a, i, _a + (i - _a) % _p) AS INT)])")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
