"""Packing token runs into windows by minimum bin slack.

Documents become token ids; a run longer than a window is cut into whole windows and a rest. Only
the counts of the lengths (at most one per possible length) reach the driver. There each window
takes the largest remaining length, and a subset-sum dynamic programme over bitsets picks the
multiset of remaining lengths that fills it closest to capacity; the counts are read off by
backtracking, and the same filling is repeated as often as the counts allow. Tasks then look up
the place of the n-th run of a length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import number_within, settled

CAPACITY = 4_096
END_ID = 2
CACHED_WORDS = 400_000

_ENCODERS: dict[str, Encoder] = {}
#: How the vocabulary splits lower-case text: contractions, letters, single digits, runs of marks.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_MARKS = regex.compile(r"(\p{N}|[^\s\p{L}\p{N}]+)")


def _latin(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)


#: The same marks for texts of the first 256 characters, which have one normal form.
_LATIN_MARKS = re.compile(rf"([{_latin('N')}]|[^\s{_latin('LN')}]+)")
#: The byte alphabet of the vocabulary: printable Latin characters stand for themselves, others follow from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Words(dict):
    """Little-endian ids of words, encoded once. When full, half of the memory starts anew."""

    def __init__(self, tokenizer) -> None:
        self.model, self.older = tokenizer.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the library gives them.

    The vocabulary drops white space and encodes words on their own, so a text is the sum of its
    words. Texts with special tokens or odd separators go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def ids(self, text: str) -> np.ndarray:
        # The four separators split for Python but are no white space to the vocabulary.
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        try:
            text.encode("latin-1")
            plain, marks = text.lower(), _LATIN_MARKS
        except UnicodeEncodeError:
            plain, marks = self.tokenizer.normalizer.normalize_str(text), _MARKS
        words = _PIECES.findall(plain) if "'" in plain else marks.sub(r" \1 ", plain).split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4")


def token_runs(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Runs of at most `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    Each document ends with id 2; a null or empty text is that id alone.
    """
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encoder.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    run = ids[start:start + capacity]
                    rows.append((doc_id, start, len(run), zlib.crc32(run.tobytes()), len(ids), *([run.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return docs.select("doc_id", "text").mapInPandas(
        runs, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to `room` from below; `lengths` descend."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        steps.append((length, reach))
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            used[length] = copies
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end, copies, first window, offset): where the runs of a length go.

    Numbers first..end - 1 of `length` fill consecutive windows from `first window`, `copies` in each, from `offset`.
    """
    counts = {length: n for length, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    used: dict[int, int] = dict.fromkeys(lengths, 0)
    rows, window = [], 0
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        taken = fill(lengths, counts, capacity - largest)
        counts[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        times = min(counts[length] // n for length, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            rows.append((length, used[length], used[length] + n * times, n, window, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        window += times
        if any(not counts[length] for length in taken):
            lengths = [length for length in lengths if counts[length]]
    return rows


def minimum_bin_slack(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`runs` (a written table with doc_id, start and length of 1 to `capacity`) with sequence_id and offset."""
    counts = {row["length"]: row["count"] for row in runs.groupBy("length").count().collect()}
    plan = np.array(plan_windows(counts, capacity), dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    numbered = number_within(runs, ["length"], ["doc_id", "start"], "_number")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 44
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            number = batch["_number"].to_numpy()
            row = plan[np.searchsorted(keys, batch["length"].to_numpy() * wide + number, side="right") - 1]
            within = number - row[:, 1]
            batch["sequence_id"] = row[:, 4] + within // row[:, 3]
            batch["offset"] = row[:, 5] + within % row[:, 3] * row[:, 0]
            yield batch.drop(columns="_number").astype({"doc_id": "Int64"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return numbered.select(*runs.columns, "_number").mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """All ids of `docs` in sequences of at most `capacity`, one row per run.

    Rows with null ids or repeated rows are packed like any other; an empty table gives no rows.
    `with_ids=False` leaves the ids out and keeps their checksum.
    """
    return minimum_bin_slack(settled(token_runs(docs, tokenizer, capacity, with_ids)), capacity)
