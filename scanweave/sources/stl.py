"""Mesh files as Spark data sources: `scan_stl` (read and write), `scan_obj`, `scan_ply`.

Paths must be visible to every executor (a mounted share or a distributed file system with a
mount). One large STL file is read by many tasks: record ranges of binary files, byte ranges of text.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The binary STL layout and the faces of a written file.
STL_HEADER_BYTES = 84
STL_RECORD = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
MAX_FACES = 10_000_000
SUFFIXES = (".stl", ".obj", ".ply")

RECORDS_PER_SPLIT = 500_000
RECORDS_PER_BATCH = 50_000
BYTES_PER_SPLIT = 128 << 20
BLOCK_BYTES = 16 << 20

_CORNERS = [f"{c}{a}" for c in "abc" for a in "xyz"]
SOUP_SCHEMA = "scan_id string, face_id long, " + ", ".join(f"{c} double" for c in _CORNERS)
INDEXED_SCHEMA = "scan_id string, item string, id long, x double, y double, z double, corners array<long>"


def list_files(path: str, suffix: str) -> list[tuple[str, str]]:
    """(scan id, file) for a folder or a pattern, in order of the files.

    The id is the path below the folder, without suffix and part number, so files of one name in
    different folders are different scans.
    """
    if os.path.isdir(path):
        root, pattern = path, os.path.join(glob.escape(path), f"**/*{suffix}")
    else:
        root, pattern = os.path.dirname(re.split(r"[*?[]", path)[0]), path
    files = sorted(glob.glob(pattern, recursive=True))
    names = [os.path.splitext(os.path.relpath(f, root or ".").replace(os.sep, "/"))[0] for f in files]
    return [(re.sub(r"\.part-\d+$", "", name), f) for name, f in zip(names, files)]


@dataclass
class StlHeader:
    """What the first bytes and the size of a file say about it."""

    name: str
    size: int
    lead: bytes

    @classmethod
    def of(cls, path: str) -> StlHeader:
        with open(path, "rb") as handle:
            return cls(os.path.basename(path), os.fstat(handle.fileno()).st_size, handle.read(STL_HEADER_BYTES))

    @property
    def records(self) -> int:
        """The record count behind the 80 free bytes; -1 in a file too short to hold one."""
        return int.from_bytes(self.lead[-4:], "little") if len(self.lead) == STL_HEADER_BYTES else -1

    @property
    def spare(self) -> int:
        """Bytes beyond the records the count asks for; negative if some are missing."""
        return self.size - STL_HEADER_BYTES - self.records * STL_RECORD.itemsize if self.records >= 0 else -1

    @property
    def is_text(self) -> bool:
        """Text opens with the word solid. A count below 2**24 has a zero byte, which text never has."""
        return self.lead.split(maxsplit=1)[:1] in ([b"solid"], [b"SOLID"], [b"Solid"]) and 0 not in self.lead


def stl_kind(path: str) -> tuple[str, int]:
    """`binary` with its record count, or `ascii`; a file that is neither raises ValueError."""
    header = StlHeader.of(path)
    if header.is_text and header.spare != 0:
        return "ascii", -1
    if header.spare < 0:
        raise ValueError(f"{header.name}: neither text nor {header.records} whole records in {header.size} bytes")
    return "binary", header.records


@dataclass
class Split(InputPartition):
    scan: str
    path: str
    kind: str
    start: int = 0
    count: int = 0
    base: int = 0


def _soup_batch(scan: str, ids: np.ndarray, corners: np.ndarray) -> pa.RecordBatch:
    flat = corners.reshape(-1, 9).astype(np.float64)
    columns = [pa.array([scan] * len(flat)), pa.array(ids)]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(flat[:, k]) for k in range(9)]], names=["scan_id", "face_id", *_CORNERS])


def read_binary(split: Split) -> Iterator[pa.RecordBatch]:
    done = 0
    while done < split.count:
        take = min(RECORDS_PER_BATCH, split.count - done)
        offset = STL_HEADER_BYTES + (split.start + done) * STL_RECORD.itemsize
        records = np.fromfile(split.path, dtype=STL_RECORD, count=take, offset=offset)
        yield _soup_batch(split.scan, split.base + split.start + done + np.arange(take), records["corners"])
        done += take


# The words of a facet from its first corner on, with their places; the next word closes it.
FACET_WORDS = {0: b"vertex", 4: b"vertex", 8: b"vertex", 12: b"endloop"}
FACET_END = b"endfacet"
_NUMBERS = [k for k in range(13) if k not in FACET_WORDS]


def _facet_corners(facets: list[bytes], name: str) -> np.ndarray:
    tails = [facet.split()[-13:] for facet in facets]
    if any(len(tail) < 13 or any(tail[k] != word for k, word in FACET_WORDS.items()) for tail in tails):
        raise ValueError(f"{name}: incomplete facet")
    return np.array([[tail[k] for k in _NUMBERS] for tail in tails]).astype(np.float32)


def read_ascii(split: Split) -> Iterator[pa.RecordBatch]:
    """The facets that open in a byte range: at the start of the file, or behind the end of a facet in the range.

    The last one may reach beyond the range. A face id is the byte at which its facet is closed,
    counted on over the parts of a scan: unique and in file order, though not without gaps.
    """
    name, stop = os.path.basename(split.path), split.start + split.count
    opened, at, rest = split.start == 0, split.start, b""
    with open(split.path, "rb") as handle:
        handle.seek(split.start)
        while chunk := handle.read(BLOCK_BYTES):
            *facets, rest = (rest + chunk.lower()).split(FACET_END)
            closed = at + np.cumsum([len(f) + len(FACET_END) for f in facets], dtype=np.int64)
            ends = closed - len(FACET_END)
            # Number of facets here whose predecessor ends in the range; the first carries `opened` on.
            last = int(np.searchsorted(ends, stop))
            own = slice(0 if opened else 1, min(last + 1, len(facets)))
            if facets[own]:
                yield _soup_batch(split.scan, split.base + ends[own], _facet_corners(facets[own], name))
            if last < len(facets):
                return
            if facets:
                opened, at = True, int(closed[-1])
    if opened and b"normal" in rest.split():
        raise ValueError(f"{name}: incomplete facet")


class StlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("recordsPerSplit", RECORDS_PER_SPLIT))
        self.bytes = int(options.get("bytesPerSplit", BYTES_PER_SPLIT))

    def partitions(self) -> list[Split]:
        """Record ranges of binary files, byte ranges of text files; parts of a scan are numbered on."""
        splits: list[Split] = []
        base: dict[str, int] = {}
        for scan, path in list_files(self.path, ".stl"):
            kind, count = stl_kind(path)
            total, step = (count, self.split) if kind == "binary" else (os.path.getsize(path), self.bytes)
            first = base.get(scan, 0)
            splits += [Split(scan, path, kind, start, min(step, total - start), first) for start in range(0, total, step)]
            base[scan] = first + total
        return splits

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from (read_binary if partition.kind == "binary" else read_ascii)(partition)


@dataclass
class Written(WriterCommitMessage):
    files: list


class StlWriter(DataSourceArrowWriter):
    """Binary STL files named by scan and part. A task writes to hidden names; the commit
    renames them, so a failed or repeated task leaves nothing behind."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        open_files: dict[str, list] = {}
        for batch in iterator:
            frame = batch.to_pandas()
            for scan, rows in frame.groupby("scan_id", sort=False):
                if scan not in open_files or open_files[scan][-1][2] + len(rows) > MAX_FACES:
                    name = os.path.join(self.path, f".{scan}.{uuid.uuid4().hex}.tmp")
                    with open(name, "wb") as handle:
                        handle.write(b"\0" * STL_HEADER_BYTES)
                    open_files.setdefault(scan, []).append([scan, name, 0])
                entry = open_files[scan][-1]
                records = np.zeros(len(rows), dtype=STL_RECORD)
                records["corners"] = rows[_CORNERS].to_numpy().reshape(-1, 3, 3)
                edges = np.diff(records["corners"].astype(np.float64), axis=1)
                normal = np.cross(edges[:, 0], edges[:, 1])
                records["normal"] = normal / np.maximum(np.linalg.norm(normal, axis=1), 1e-300)[:, None]
                with open(entry[1], "ab") as handle:
                    records.tofile(handle)
                entry[2] += len(rows)
        done = [entry for entries in open_files.values() for entry in entries]
        for _, name, count in done:
            with open(name, "r+b") as handle:
                handle.seek(80)
                handle.write(np.uint32(count).tobytes())
            if stl_kind(name)[1] != count:
                raise OSError(f"{name}: {count} faces written, file does not match")
        return Written(done)

    def commit(self, messages: list) -> None:
        number: dict[str, int] = {}
        for scan, name, _ in sorted(entry for message in messages if message for entry in message.files):
            part = number.get(scan, 0)
            number[scan] = part + 1
            os.replace(name, os.path.join(self.path, f"{scan}.part-{part}.stl"))

    def abort(self, messages: list) -> None:
        for _, name, _ in (entry for message in messages if message for entry in message.files):
            if os.path.exists(name):
                os.remove(name)


class StlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_stl"

    def schema(self) -> str:
        return SOUP_SCHEMA

    def reader(self, schema) -> StlReader:
        return StlReader(self.options)

    def writer(self, schema, overwrite: bool) -> StlWriter:
        return StlWriter(self.options)


# ---------------------------------------------------------------- indexed text and PLY files


def _indexed(scan: str, item: str, first: int, points=None, corners=None) -> pa.RecordBatch:
    n = len(points) if points is not None else len(corners)
    none = pa.nulls(n, pa.float64())
    xyz = [pa.array(points[:, k]) for k in range(3)] if points is not None else [none] * 3
    loops = pa.array([list(map(int, c)) for c in corners], pa.list_(pa.int64())) if corners is not None else pa.nulls(n, pa.list_(pa.int64()))
    arrays = [pa.array([scan] * n), pa.array([item] * n), pa.array(np.arange(first, first + n)), *xyz, loops]
    return pa.RecordBatch.from_arrays(arrays, names=["scan_id", "item", "id", "x", "y", "z", "corners"])


def read_obj(split: Split) -> Iterator[pa.RecordBatch]:
    """Vertices and polygons in file order; `a/b/c` suffixes and colours are ignored, ids are
    0-based and negative references count back from the last vertex."""
    scan, vertices, faces = split.scan, 0, 0
    with open(split.path, "rb") as handle:
        while lines := handle.readlines(BLOCK_BYTES):
            points, loops = [], []
            for fields in map(bytes.split, lines):
                if fields[:1] == [b"v"]:
                    points.append([float(v) for v in fields[1:4]])
                elif fields[:1] == [b"f"]:
                    index = [int(f.split(b"/")[0]) for f in fields[1:]]
                    loops.append([i - 1 if i > 0 else vertices + len(points) + i for i in index])
            if points:
                yield _indexed(scan, "vertex", vertices, points=np.array(points))
                vertices += len(points)
            if loops:
                yield _indexed(scan, "face", faces, corners=loops)
                faces += len(loops)


# The PLY scalar types.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def read_ply(split: Split) -> Iterator[pa.RecordBatch]:
    """ASCII and little-endian PLY with `vertex` and `face` elements."""
    scan = split.scan
    with open(split.path, "rb") as handle:
        elements, form = [], ""
        for raw in iter(handle.readline, b""):
            words = raw.decode("ascii").split()
            if words[:1] == ["format"]:
                form = words[1]
            elif words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append(words[1:])
            elif words[:1] == ["end_header"]:
                break
        if form not in ("ascii", "binary_little_endian"):
            raise ValueError(f"{os.path.basename(split.path)}: PLY format {form!r} is not read")
        for name, count, properties in elements:
            names = [p[-1] for p in properties]
            lists = [p for p in properties if p[0] == "list"]
            done = 0
            while done < count:
                take = min(RECORDS_PER_BATCH, count - done)
                if form == "ascii":
                    rows = [handle.readline().split() for _ in range(take)]
                elif not lists:
                    kind = np.dtype([(n, "<" + PLY_TYPES[p[0]]) for n, p in zip(names, properties)])
                    data = np.fromfile(handle, dtype=kind, count=take)
                else:
                    rows = [_ply_row(handle, properties) for _ in range(take)]
                if name == "vertex":
                    if form == "ascii":
                        at = [names.index(c) for c in "xyz"]
                        points = np.array([[float(r[k]) for k in at] for r in rows])
                    else:
                        points = np.column_stack([data[c].astype(np.float64) for c in "xyz"])
                    yield _indexed(scan, "vertex", done, points=points)
                elif name == "face":
                    loops = [r[1:1 + int(r[0])] for r in rows] if form == "ascii" else rows
                    yield _indexed(scan, "face", done, corners=loops)
                done += take


def _ply_row(handle, properties) -> list:
    found: list = []
    for p in properties:
        if p[0] == "list":
            n = int(np.fromfile(handle, "<" + PLY_TYPES[p[1]], 1)[0])
            values = np.fromfile(handle, "<" + PLY_TYPES[p[2]], n)
            if p[-1] in ("vertex_indices", "vertex_index"):
                found = list(values)
        else:
            np.fromfile(handle, "<" + PLY_TYPES[p[0]], 1)
    return found


class IndexedReader(DataSourceReader):
    def __init__(self, options: dict, suffix: str) -> None:
        self.path, self.suffix = options["path"], suffix

    def partitions(self) -> list[Split]:
        # References are relative to the file, so a file is one partition.
        return [Split(scan, path, self.suffix) for scan, path in list_files(self.path, self.suffix)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from (read_obj if self.suffix == ".obj" else read_ply)(partition)


class ObjSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_obj"

    def schema(self) -> str:
        return INDEXED_SCHEMA

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options, ".obj")


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_ply"

    def schema(self) -> str:
        return INDEXED_SCHEMA

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options, ".ply")


def register(spark: SparkSession) -> None:
    for source in (StlSource, ObjSource, PlySource):
        spark.dataSource.register(source)
