"""Removal of repeated byte strings with sorted suffixes.

Every string of LENGTH bytes holds an anchor: the gram of GRAM bytes whose hash is the smallest in it.
Equal strings have equal anchors at equal places, so only anchors that occur twice matter, and only
occurrences of one anchor can share a string. Occurrences whose whole surroundings are equal are
settled by hash: all but the first are repeats. For the different surroundings of an anchor, the
suffixes that start at it and the reversed prefixes before it are sorted deep-shallow: multikey
quicksort up to SHALLOW bytes, then a blind trie for each group that still agrees. Two occurrences
share a string with `a` bytes before the anchor if they lie in one interval of common prefix LENGTH - a
of the first order and a of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import forget, settled

LENGTH = 100
GRAM = 32
SHALLOW = 24
SMALL = 24
#: Anchors with more different surroundings are compared by their hashed strings over many tasks.
CLASS_ROWS = 1_000
BUCKET_ROWS = 8_000
#: Neighbouring strings over such an anchor that are hashed one by one only where the bytes common to them occur twice.
PART = 12
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(41)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)])
                          for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of `width` values."""
    reach, out = 1, values
    while 2 * reach <= width:
        out, reach = pick(out[:-reach], out[reach:]), 2 * reach
    return out if reach == width else pick(out[:len(out) - (width - reach)], out[width - reach:])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and hashes of the surroundings of a text's anchors."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * power[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    width = LENGTH - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    # The largest of the minima of the windows over a gram equals it just if it is one's minimum.
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.r_[edge, least, edge], width, np.maximum) == grams)
    start, end = np.maximum(0, at - (LENGTH - GRAM)), np.minimum(n, at + LENGTH)
    around = (sums[end] - sums[start]) * inverse[start]
    around = _mix(around + (at - start).astype(np.uint64) * _BYTE[1] + (end - at).astype(np.uint64) * _BYTE[2])
    return at, grams[at].view(np.int64), around.view(np.int64)


def _multikey(words: np.ndarray, rows: np.ndarray, depth: int, out: list[np.ndarray]) -> None:
    """Ternary quicksort by one 8-byte word after another; groups equal in all words go to `out` whole."""
    todo = [(rows, 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) == 1 or depth == words.shape[1]:
            out.append(rows)
            continue
        key = words[rows, depth]
        if len(rows) <= SMALL:
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            parts = np.split(rows, np.flatnonzero(key[1:] != key[:-1]) + 1)
            todo += [(part, depth + 1) for part in reversed(parts)]
            continue
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        same = rows[key == pivot]
        less, more = rows[key < pivot], rows[key > pivot]
        if len(more):
            todo.append((more, depth))
        todo.append((same, depth + 1))
        if len(less):
            todo.append((less, depth))


def _blind_trie(rows: list[int], strings: list[bytes]) -> list[int]:
    """`rows` by their strings of one length. Inner nodes are [place, {byte: child}] and tell only where
    strings differ; a string goes down blindly to a leaf, and one comparison with it gives its place."""
    root: list | tuple = ([rows[0]],)
    for row in rows[1:]:
        s, path, node = strings[row], [], root
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[0][0]]
        if s == t:
            node[0].append(row)
            continue
        differ = int.from_bytes(s) ^ int.from_bytes(t)
        place = len(s) - (differ.bit_length() + 7) // 8
        above, below = None, root
        for inner in path:
            below = inner
            if inner[0] >= place:
                break
            above, below = inner, inner[1].get(s[inner[0]])
        if isinstance(below, list) and below[0] == place:
            below[1][s[place]] = ([row],)
            continue
        if below is None:
            above[1][s[above[0]]] = ([row],)
            continue
        split = [place, {t[place]: below, s[place]: ([row],)}]
        if above is None:
            root = split
        else:
            above[1][s[above[0]]] = split
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node[0]
    return out


def deep_shallow(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (cut or filled to `depth` bytes, shorter first) and each one's common prefix with the one before."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    filled = [s.ljust(depth, b"\0") for s in strings]
    table = np.frombuffer(b"".join(filled), dtype=np.uint8).reshape(len(strings), depth)
    shallow = min(SHALLOW, depth // 8 * 8)
    words = np.ascontiguousarray(table[:, :shallow]).view(">u8").astype(np.uint64)
    groups: list[np.ndarray] = []
    _multikey(words, np.argsort(sizes, kind="stable"), 0, groups)
    order = np.array([row for g in groups for row in (g if len(g) == 1 else _blind_trie(g.tolist(), filled))], dtype=np.int64)
    common = np.zeros(len(order), dtype=np.int64)
    for start in range(1, len(order), 65_536):
        a, b = order[start - 1:start + 65_535], order[start:start + 65_536]
        a = a[:len(b)]
        differ = table[a] != table[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        common[start:start + len(b)] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return order, common


def _intervals(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the interval of common prefix `depth` that each string lies in."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Bytes that the surroundings of a bucket's anchors share with earlier ones."""
    right, left = list(frame["suffix"]), [s[::-1] for s in frame["prefix"]]
    size_r, size_l = np.fromiter(map(len, right), np.int64, len(right)), np.fromiter(map(len, left), np.int64, len(left))
    by_right, by_left = deep_shallow(right, LENGTH), deep_shallow(left, LENGTH - GRAM)
    turn = np.lexsort((frame["pos"], frame["text_hash"], frame["id"]))
    keys = frame[["id", "text_hash", "pos"]].to_numpy()
    rank = np.empty(len(frame), dtype=np.int64)
    rank[turn] = np.cumsum(np.r_[0, (keys[turn][1:] != keys[turn][:-1]).any(axis=1)])
    most, least = np.full(len(frame), -1), np.full(len(frame), LENGTH)
    for a in range(LENGTH - GRAM + 1):
        rows = np.flatnonzero((size_l >= a) & (size_r >= LENGTH - a))
        key = _intervals(*by_right, LENGTH - a)[rows] * (len(frame) + 1) + _intervals(*by_left, a)[rows]
        turn = np.lexsort((rank[rows], key))
        key, rows = key[turn], rows[turn]
        starts = np.r_[True, key[1:] != key[:-1]][:len(key)]
        first = rank[rows][np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))] if len(key) else rank[rows]
        again = rows[rank[rows] > first]
        most[again] = a
        least[again] = np.minimum(least[again], a)
    hit = most >= 0
    found = frame.loc[hit, ["id", "text_hash"]]
    return found.assign(start=frame["pos"][hit] - most[hit], end=frame["pos"][hit] - least[hit] + LENGTH)


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each PART of the strings over an anchor, the hash of the bytes that all of them hold."""
    most = LENGTH - GRAM
    for batch in batches:
        rows = []
        for doc, text, pos, prefix, suffix in batch[["id", "text_hash", "pos", "prefix", "suffix"]].itertuples(index=False):
            whole, anchor = prefix + suffix, len(prefix)
            for low in range(0, min(anchor, most) + 1, PART):
                length = LENGTH - min(low + PART - 1, most)
                if length <= len(suffix):
                    rows.append((xxhash.xxh3_64_intdigest(whole[anchor - low:anchor + length], seed=low) - (1 << 63), low // PART, doc, text, pos))
        yield pd.DataFrame(rows, columns=["core", "part", "id", "text_hash", "pos"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The strings of LENGTH bytes over each anchor in its `parts`, as hashes, with the bytes before the anchor."""
    for batch in batches:
        rows = []
        for h, doc, text, pos, prefix, suffix, parts in batch[["h", "id", "text_hash", "pos", "prefix", "suffix", "parts"]].itertuples(index=False):
            whole, chosen = prefix + suffix, set(parts)
            for before in range(max(0, LENGTH - len(suffix)), min(len(prefix), LENGTH - GRAM) + 1):
                if before // PART not in chosen:
                    continue
                start = len(prefix) - before
                rows.append((h, before, xxhash.xxh3_64_intdigest(whole[start:start + LENGTH]) - (1 << 63), doc, text, pos))
        yield pd.DataFrame(rows, columns=["h", "before", "window", "id", "text_hash", "pos"])


_CONTEXT = "h long, id long, text_hash long, pos long, prefix binary, suffix binary"
_SPAN = "id long, text_hash long, start long, end long"


def _located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cols = {name: [] for name in ("id", "text_hash", "h", "around", "pos")}
        for doc, text, value in zip(batch["id"], batch["text_hash"], batch["text"]):
            pos, h, around = anchors((value or "").encode("utf-8", "replace"))
            for name, values in (("id", np.full(len(pos), doc)), ("text_hash", np.full(len(pos), text)), ("h", h), ("around", around), ("pos", pos)):
                cols[name].append(values)
        yield pd.DataFrame({name: np.concatenate([np.zeros(0, np.int64), *parts]) for name, parts in cols.items()})


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before = LENGTH - GRAM
    for batch in batches:
        raws = [(value or "").encode("utf-8", "replace") for value in batch["text"]]
        counts = [len(pos) for pos in batch["pos"]]
        pos = np.concatenate([np.zeros(0, np.int64), *batch["pos"]])
        yield pd.DataFrame({
            "h": np.concatenate([np.zeros(0, np.int64), *batch["h"]]), "id": np.repeat(batch["id"].to_numpy(), counts),
            "text_hash": np.repeat(batch["text_hash"].to_numpy(), counts), "pos": pos,
            "prefix": [raw[max(0, p - before):p] for raw, places in zip(raws, batch["pos"]) for p in places],
            "suffix": [raw[p:p + LENGTH] for raw, places in zip(raws, batch["pos"]) for p in places]})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, text_hash, start, end): bytes of repeats, overlapping, for `docs(id, text_hash, text)`."""
    # Tables that grow with the anchors are merged at every size: a broadcast of them is built in the driver's memory.
    everywhere = settled(docs.mapInPandas(_located, "id long, text_hash long, h long, around long, pos long"))
    often = settled(everywhere.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    found = settled(everywhere.join(often.hint("merge"), "h"))
    forget(everywhere, often)
    place = F.struct("id", "text_hash", "pos")
    kinds = settled(found.groupBy("h", "around").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    copies = settled(found.join(kinds.filter("n > 1").hint("merge"), ["h", "around"]).filter(place != F.col("first"))
                     .select("id", "text_hash", F.greatest(F.col("pos") - (LENGTH - GRAM), F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end")))
    forget(found)
    mixed = settled(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    several = kinds.join(mixed.hint("merge"), "h").select("h", "first.*")
    by_doc = several.groupBy("id", "text_hash").agg(F.collect_list(F.struct("h", "pos")).alias("places"))
    # Texts are merged with their places at every size, so small and large tables share one plan.
    around = settled(docs.join(by_doc.hint("merge"), ["id", "text_hash"])
                     .select("id", "text_hash", "text", F.col("places.h").alias("h"), F.col("places.pos").alias("pos")).mapInPandas(_contexts, _CONTEXT))
    forget(kinds)
    hot = settled(mixed.filter(F.col("kinds") > CLASS_ROWS).select("h"))
    buckets = max(1, -(-around.count() // BUCKET_ROWS))
    sorted_ = settled(around.join(hot, "h", "left_anti").withColumn("_bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
                      .groupBy("_bucket").applyInPandas(_shared, _SPAN))
    crowded = settled(around.join(hot, "h", "left_semi"))
    forget(around, mixed, hot)
    # Equal strings have equal cores, so a core that occurs once rules out its part of the strings.
    cores = settled(crowded.mapInPandas(_cores, "core long, part int, id long, text_hash long, pos long"))
    twice = cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    parts = (cores.join(twice.hint("merge"), "core").groupBy("id", "text_hash", "pos").agg(F.collect_set("part").alias("parts")))
    windows = settled(crowded.join(parts.hint("merge"), ["id", "text_hash", "pos"])
                      .mapInPandas(_windows, "h long, before int, window long, id long, text_hash long, pos long"))
    forget(crowded, cores)
    firsts = windows.groupBy("h", "before", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    hashed = settled(windows.join(firsts.hint("merge"), ["h", "before", "window"]).filter(place != F.col("first"))
                     .groupBy("id", "text_hash", "pos").agg(F.max("before").alias("most"), F.min("before").alias("least"))
                     .select("id", "text_hash", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("end")))
    forget(windows)
    return copies.unionByName(sorted_).unionByName(hashed)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n_bytes, spans_out, kept_out = [], [], []
        for value, starts, ends in zip(batch["text"], batch["starts"], batch["ends"]):
            raw = (value or "").encode("utf-8", "replace")
            merged: list[list[int]] = []
            for start, end in [] if starts is None else sorted(zip(starts.tolist(), np.minimum(ends, len(raw)).tolist())):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            edges = [0, *[x for span in merged for x in span], len(raw)]
            n_bytes.append(len(raw))
            spans_out.append([{"start": s, "end": e} for s, e in merged])
            kept_out.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
        yield batch.drop(columns=["text", "starts", "ends"]).assign(n_bytes=n_bytes, spans=spans_out, kept=kept_out).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_bytes, spans array<struct<start, end>> and kept (binary) for every row of `docs`.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a document with a
    smaller id, or before in its own. A null id is smaller than any other; texts of one id follow
    each other by their hash; rows equal in id and text are one document, each with the same
    result. Null and empty texts have no bytes. An empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = (repeated_spans(keyed.select("id", "text_hash", "text")).groupBy("id", "text_hash")
             .agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    cut = keyed.join(spans.hint("merge"), ["id", "text_hash"], "left").select(
        "doc_id", "text_hash", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return cut.mapInPandas(_cut, "doc_id long, text_hash long, n_bytes long, spans array<struct<start long, end long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeats cut from their texts; bytes of a broken character go too, and n_chars follows."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_hash", F.xxhash64("text"))
    spans = (repeated_spans(keyed.select(F.col("_id").alias("id"), F.col("_hash").alias("text_hash"), "text")).groupBy("id", "text_hash")
             .agg(F.collect_set(F.struct("start", "end")).alias("_spans")).withColumnsRenamed({"id": "_id", "text_hash": "_hash"}))

    @F.pandas_udf("string")
    def shorter(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"doc_id": 0, "text": text, "starts": starts, "ends": ends})
        kept = next(_cut(iter([frame])))["kept"]
        return pd.Series([None if t is None else k.decode("utf-8", "ignore") for t, k in zip(text, kept)])

    cut = keyed.join(spans.hint("merge"), ["_id", "_hash"], "left").withColumn("text", shorter("text", "_spans.start", "_spans.end"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
