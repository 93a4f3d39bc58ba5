"""SentencePiece encoding that keeps the place of every piece in the source bytes, and decoding.

The normaliser takes, at each place, the longest key of the model's compiled character map (a
double-array trie over bytes) and records for every normalised byte the source byte it came from.
Pieces are then merged by score in the normalised text, and each is projected back through that
record to the source bytes it stands for. The spans of a text's pieces follow each other without gaps.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import flat_bytes

#: Stands for a space in pieces.
SPACE = "▁"
#: What an invalid byte becomes.
REPLACED = "�"
CACHED = 200_000
CACHED_CHARS = 64
#: Parts up to so many characters are merged by looking through a list, longer ones by a queue.
SHORT_CHARS = 32
_NEVER = (float("inf"), -1)
OUT_TOKENS = 1 << 20

#: Piece kinds and field numbers of the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_BPE = 2

_MODELS: dict[str, Model] = {}


def _fields(data: bytes) -> dict[int, list]:
    """Values of a protocol-buffer message by field number."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at:at + size]
            at += size
        out.setdefault(tag >> 3, []).append(value)
    return out


class CharMap:
    """Longest-prefix rewriting by the compiled map: the trie's size in bytes, its units, then the rewritten strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist() if size else []
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Bytes of the longest key at `at` and the place of its rewritten string; 0 bytes if none."""
        units = self.units
        if not units:
            return 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        size = place = 0
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                size, place = i + 1 - at, units[node] & 0x7FFFFFFF
        return size, place

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The normalised bytes of the next source bytes, and how many those are."""
        size, place = self.longest(data, at)
        if size:
            return self.strings[place:self.strings.index(0, place)], size
        lead = data[at]
        width = 1 if lead < 128 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        char = data[at:at + width]
        try:
            if width and len(char.decode()) == 1:
                return char, width
        except UnicodeDecodeError:
            pass
        return REPLACED.encode(), 1


class Normaliser:
    """Rewrites a text as the model asks and keeps, per normalised byte, where it came from."""

    def __init__(self, spec: bytes) -> None:
        fields = _fields(spec)
        self.map = CharMap(fields.get(2, [b""])[0])
        self.dummy = bool(fields.get(3, [1])[0])
        self.squeeze = bool(fields.get(4, [1])[0])
        self.escape = bool(fields.get(5, [1])[0])
        #: Without a map, and with spaces kept, only the space changes.
        self.plain = not self.map.units and not self.squeeze and self.escape

    def walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and the source place of each (one more for the end)."""
        out, places = bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        at = 0
        if self.squeeze:
            while at < len(data):
                part, width = self.map.prefix(data, at)
                if part != b" ":
                    break
                at += width
        if at == len(data):
            return b"", np.zeros(1, dtype=np.int64)
        if self.dummy:
            out += space
            places += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            part, width = self.map.prefix(data, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                new = part.replace(b" ", space)
                out += new
                places += [at] * len(new)
                after_space = part.endswith(b" ")
            at += width
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space):]
                at = places[-len(space)]
                del places[-len(space):]
        return bytes(out), np.array([*places, at], dtype=np.int64)

    def run(self, data: bytes) -> tuple[str, np.ndarray]:
        """As `walk`, as text; texts in which only spaces change are placed all at once."""
        if self.plain and data:
            try:
                text = data.decode()
            except UnicodeDecodeError:
                text = None
            if text is not None:
                width = np.where(np.frombuffer(data, dtype=np.uint8) == 32, 3, 1)
                lead = 3 if self.dummy else 0
                places = np.r_[np.zeros(lead, dtype=np.int64), np.repeat(np.arange(len(data)), width), len(data)]
                return (SPACE if self.dummy else "") + text.replace(" ", SPACE), places
        found, places = self.walk(data)
        return found.decode(), places


class Entries(dict):
    """(id, normalised bytes) pairs of a part's pieces; half of the memory starts anew when full."""

    def __init__(self, model: Model) -> None:
        self.model, self.older = model, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.model.pieces_of(part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found


class Model:
    """A byte-pair model with byte fallback, as its file describes it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            fields = _fields(file.read())
        trainer = _fields(fields[2][0])
        if trainer.get(3, [1])[0] != _BPE or not trainer.get(35, [0])[0]:
            raise ValueError("a byte-pair model with byte fallback is needed")
        self.unknown_text = trainer.get(44, [" ⁇ ".encode()])[0]
        self.normaliser = Normaliser(fields[3][0])
        self.score: dict[str, tuple[float, int]] = {}
        self.bytes_at, self.kinds, self.surfaces = [0] * 256, [], []
        for number, piece in enumerate(map(_fields, fields[1])):
            text, kind = piece[1][0].decode(), piece.get(3, [NORMAL])[0]
            self.kinds.append(kind)
            if kind == BYTE:
                self.bytes_at[int(text[1:-1], 16)] = number
                self.surfaces.append(bytes([int(text[1:-1], 16)]))
            elif kind == NORMAL:
                self.score[text] = (-struct.unpack("<f", piece[2][0])[0] if 2 in piece else 0.0, number)
                self.surfaces.append(text.replace(SPACE, " ").encode())
            elif kind in (CONTROL, UNKNOWN):
                self.surfaces.append(self.unknown_text if kind == UNKNOWN else b"")
            else:
                raise ValueError("user-defined and unused pieces are not handled")
        self.kinds = np.array(self.kinds)
        #: Where no piece goes on past a space mark, the marks cut a text into parts of their own; so do characters no longer piece holds.
        shared = set().union(*(p for p in self.score if len(p) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in shared)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.parts = None if crossing or SPACE not in shared else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.packed = {text: array("i", [number, len(text.encode())]).tobytes() for text, (_, number) in self.score.items()}
        self.entries = Entries(self)
        self.sizes = np.array([len(s) for s in self.surfaces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.surfaces), dtype=np.uint8)
        self.opens = np.array([kind == NORMAL and s.startswith(b" ") for kind, s in zip(self.kinds, self.surfaces)])

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def merged(self, part: str) -> list[str]:
        """Characters merged pair by pair, best score first, then leftmost."""
        if len(part) > SHORT_CHARS:
            return self._merged_long(part)
        symbols, get = list(part), self.score.get
        costs = [get(a + b, _NEVER)[0] for a, b in zip(symbols, symbols[1:])]
        while costs:
            least = min(costs)
            if least == _NEVER[0]:
                break
            at = costs.index(least)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = get(symbols[at - 1] + symbols[at], _NEVER)[0]
            if at < len(costs):
                costs[at] = get(symbols[at] + symbols[at + 1], _NEVER)[0]
        return symbols

    def _merged_long(self, part: str) -> list[str]:
        """The same with a queue of pairs, for parts of any length."""
        symbols = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                both = symbols[left] + symbols[right]
                known = self.score.get(both)
                if known is not None:
                    heapq.heappush(queue, (known[0], left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one side has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def pieces_of(self, part: str) -> bytes:
        """Pairs of ids and normalised bytes; of the bytes of a fallen-back character the last one stands for all."""
        symbols, packed = self.merged(part), self.packed
        try:
            return b"".join([packed[s] for s in symbols])
        except KeyError:
            return b"".join([packed.get(s) or self._bytes_of(s) for s in symbols])

    def _bytes_of(self, char: str) -> bytes:
        data = char.encode()
        return array("i", [x for k, b in enumerate(data, 1) for x in (self.bytes_at[b], len(data) if k == len(data) else 0)]).tobytes()

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and the first and past-the-end source byte of each."""
        text, places = self.normaliser.run(data)
        parts = [text] if self.parts is None and text else self.parts.findall(text) if text else []
        found = np.frombuffer(b"".join(map(self.entries.__getitem__, parts)), dtype=np.intc).reshape(-1, 2)
        stop = np.cumsum(found[:, 1], dtype=np.int64)
        return found[:, 0], places[stop - found[:, 1]], places[stop]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one list of ids, step by step."""
        out, pending, seen = [], bytearray(), False

        def flush() -> None:
            while pending:
                part, width = CharMap(b"").prefix(bytes(pending[:4]), 0)
                out.append(part)
                del pending[:width]

        for number in ids:
            surface = self.surfaces[number]
            if self.kinds[number] == BYTE:
                pending += surface
                continue
            flush()
            if not seen and not any(out) and self.opens[number] and (self.normaliser.dummy or self.normaliser.squeeze):
                surface, seen = surface[1:], not self.normaliser.squeeze
            out.append(surface)
        flush()
        return b"".join(out).decode()

    def decode_rows(self, ids: np.ndarray, places: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of many lists of ids (row i is ids[places[i]:places[i + 1]]) side by side, and where each ends."""
        if self.normaliser.squeeze:
            texts = [self.decode(ids[a:b]).encode() for a, b in zip(places[:-1], places[1:])]
            return b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        sizes, starts = self.sizes[ids], self.starts[ids]
        row = np.repeat(np.arange(len(places) - 1), np.diff(places))
        if self.normaliser.dummy and len(ids):
            # The first piece that is not control gives up its leading space.
            told = np.flatnonzero(self.kinds[ids] != CONTROL)
            first = told[np.unique(row[told], return_index=True)[1]]
            first = first[self.opens[ids[first]]]
            sizes[first] -= 1
            starts[first] += 1
        stops = np.r_[0, np.cumsum(sizes)]
        flat = self.blob[np.arange(stops[-1]) - np.repeat(stops[:-1] - starts, sizes)]
        ends = stops[places[1:]]
        odd = {}
        for i in np.unique(row[self.kinds[ids] == BYTE]):
            held = ids[places[i]:places[i + 1]]
            try:
                flat[ends[i - 1] if i else 0:ends[i]].tobytes().decode()
                split = (self.kinds[held] == CONTROL).any()
            except UnicodeDecodeError:
                split = True
            if split:  # bytes that make no character, or that control pieces keep apart, are replaced one by one
                odd[i] = self.decode(held).encode()
        if odd:
            texts = [odd.get(i, flat[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends))]
            return b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        return flat.tobytes(), ends


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins and ends of every row of `docs(doc_id, text)`.

    `path` names the model file on every executor. Piece i stands for the source bytes begins[i] up to
    ends[i] of the UTF-8 text; a character without a piece becomes its bytes, of which the last has
    the span. Null and empty texts have no pieces; null ids and repeated rows stay as they are; an
    empty table gives no rows. A text is one task's work, whatever its length.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.at(path)
        for batch in batches:
            flat, places = flat_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                first, found, count = at, [], 0
                while at < batch.num_rows and count < OUT_TOKENS:
                    found.append(model.encode(flat[places[at]:places[at + 1]].tobytes()))
                    count += len(found[-1][0])
                    at += 1
                offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *lists], ["doc_id", "ids", "begins", "ends"])

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(encode, "doc_id long, ids array<int>, begins array<int>, ends array<int>"))


def decoded(ids: Column | str, path: str) -> Column:
    """The text of a column of id lists; a null list is null, an empty one the empty text."""
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        model, out, at = Model.at(path), [], 0
        values = lists.values.to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
        places = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        while at < len(lists):
            stop = max(at + 1, int(np.searchsorted(places, places[at] + OUT_TOKENS, side="right")) - 1)
            stop = min(stop, len(lists))
            text, ends = model.decode_rows(values[places[at]:places[stop]], places[at:stop + 1] - places[at])
            offsets = np.r_[0, ends].astype(np.int32)
            out.append(pa.Array.from_buffers(pa.string(), stop - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)]))
            at = stop
        whole = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pc.if_else(lists.is_valid(), whole, None) if lists.null_count else whole

    return decode(ids)


def piece_digest(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of `encode_documents`: doc_id, n_tokens, digests of the ids and of the decoded text, and the bytes its spans cover."""
    # Spans follow each other without gaps.
    covered = F.when(F.size("ids") > 0, F.element_at("ends", -1) - F.element_at("begins", 1)).otherwise(0).cast("long")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decoded("ids", path), 256).alias("decoded_sha256"), covered.alias("span_bytes"))
