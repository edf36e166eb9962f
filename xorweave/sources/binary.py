"""Flat files of fixed-width records: keys (8 bytes) and shares (20 bytes), little-endian.

``spark.read.format("xor_keys").load(uri)`` and ``"xor_shares"`` read a file, a folder with what is in
it, or a list of these, in ranges of whole records, as Arrow batches; ``df.write.format("xor_keys")`` writes
one file per task. Paths are anything pyarrow.fs opens. Trailing bytes of a record that isn't whole raise.

Comparisons with constants are pushed down (``register`` switches Spark's pushdown to such sources on): a range
drops its rows before they become Arrow batches, and of a sorted folder only the ranges that can hold
such keys are opened.

A sorted folder is written by ``.option("sorted", "true")`` from keys in ascending order without sign
(lists.sort_keys); its manifest tells the parts in order, with their numbers and least and greatest keys.

Keys can be read with their place: ``.option("positions", "true")`` gives pos, h and before, the key in front of
it, also over the ends of ranges and parts; ``.option("ascending", "true")`` raises where one is less than that.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

KEY = np.dtype([("h", "<i8")])
SHARE = np.dtype([("kind", "<i2"), ("difficulty", "<i2"), ("extraNonce2", "<u4"), ("extraNonce1", "<u4"), ("nonce", "<u4"), ("ntime", "<u4")])
RANGE_BYTES = 64 << 20
BATCH = 1 << 16
MANIFEST = "_sorted.json"
TOP = 1 << 64
COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: np.isin}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def listed(uri: str) -> list[fs.FileInfo]:
    """A file, or the files of a folder and those below it, by path; names that start with . or _ don't count."""
    where, path = opened(uri)
    info = where.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    inside = where.get_file_info(fs.FileSelector(path, recursive=True))
    shown = lambda f: not any(x.startswith((".", "_")) for x in f.path[len(path) :].split("/"))
    return sorted((f for f in inside if f.type == fs.FileType.File and shown(f)), key=lambda f: f.path)


def manifest(uri: str) -> list[dict] | None:
    """The parts (path, n, least, greatest) of a sorted folder in order; None of any other."""
    where, path = opened(uri)
    if where.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.File:
        return None
    with where.open_input_file(f"{path}/{MANIFEST}") as f:
        parts = json.loads(f.read())
    for p in parts:
        p["path"] = f"{path}/{p['name']}"
        if where.get_file_info(p["path"]).size != 8 * p["n"]:
            raise ValueError(f"{p['path']} doesn't hold {p['n']} keys")
    return parts


class Probe:
    """A part of sorted keys as a sequence, of which an element is a seek and a read of 8 bytes."""

    def __init__(self, file: object, n: int) -> None:
        self.file, self.n, self.reads = file, n, 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        self.reads += 1
        self.file.seek(8 * i)
        return int.from_bytes(self.file.read(8), "little")


def widened(rows: np.ndarray) -> dict[str, np.ndarray]:
    return {n: rows[n].astype(np.int64 if rows[n].dtype == np.uint32 else rows[n].dtype.newbyteorder("=")) for n in rows.dtype.names}


class Range(InputPartition):
    """``first`` is the number of records in front of it; ``before`` the file and place of the record in front, if any."""

    def __init__(self, uri: str, path: str, start: int, size: int, first: int, before: tuple[str, int] | None) -> None:
        self.uri, self.path, self.start, self.size, self.first, self.before = uri, path, start, size, first, before


class RecordReader(DataSourceReader):
    def __init__(self, uris: list[str], kind: np.dtype, positions: bool = False, ascending: bool = False) -> None:
        self.uris, self.kind, self.positions, self.ascending = uris, kind, positions, ascending
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (*COMPARE, IsNotNull)) and len(f.attribute) == 1 else None
            if column in self.kind.names and isinstance(f, IsNotNull):
                continue
            value = getattr(f, "value", None)
            values = list(value) if isinstance(f, In) else [value]
            if column in self.kind.names and all(isinstance(v, int) for v in values):
                self.wanted.append((column, type(f), values if isinstance(f, In) else value))
            else:
                yield f

    def key_ranges(self) -> list[tuple[int, int]]:
        """What the pushed comparisons leave of the keys without sign, as ranges (least, beyond the greatest)."""
        low, high = -(1 << 63), (1 << 63) - 1
        for column, how, value in self.wanted:
            least, most = (min(value), max(value)) if how is In else (value, value)
            if column == "h" and how is not LessThan and how is not LessThanOrEqual:
                low = max(low, least + (how is GreaterThan))
            if column == "h" and how is not GreaterThan and how is not GreaterThanOrEqual:
                high = min(high, most - (how is LessThan))
        signs = [(max(low, 0), high + 1), (low + TOP, min(high + 1, 0) + TOP)]
        return [(a, b) for a, b in signs if a < b]

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        first, before = 0, None
        step = RANGE_BYTES // self.kind.itemsize
        for uri in self.uris:
            parts = manifest(uri) if self.kind is KEY else None
            if parts is None:
                parts = [{"path": f.path, "size": f.size} for f in listed(uri)]
            where, _ = opened(uri)
            for p in parts:
                if p.get("size", 0) % self.kind.itemsize:
                    raise ValueError(f"{p['path']}: {p['size']} bytes aren't whole records of {self.kind.itemsize}")
                n = p.get("n", p.get("size", 0) // self.kind.itemsize)
                spans = [(0, n)]
                if "least" in p:
                    ranges = [(a, b) for a, b in self.key_ranges() if a <= p["greatest"] and b > p["least"]]
                    if ranges == [(0, TOP >> 1), (TOP >> 1, TOP)] or any(a <= p["least"] and p["greatest"] < b for a, b in ranges):
                        pass
                    elif ranges:
                        with where.open_input_file(p["path"]) as f:
                            spans = [(bisect_left(Probe(f, n), a), bisect_left(Probe(f, n), b)) for a, b in ranges]
                    else:
                        spans = []
                for low, high in spans:
                    for at in range(low, high, step):
                        front = (p["path"], at - 1) if at else before
                        out.append(Range(uri, p["path"], at * self.kind.itemsize, min(step, high - at) * self.kind.itemsize, first + at, front))
                first += n
                before = (p["path"], n - 1) if n else before
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was no range to read
            return
        where, _ = opened(partition.uri)
        place, front = partition.first, None
        if (self.positions or self.ascending) and partition.before:
            path, at = partition.before
            with where.open_input_file(path) as f:
                f.seek(at * self.kind.itemsize)
                front = np.frombuffer(f.read(self.kind.itemsize), dtype="<i8")[0]
        with where.open_input_file(partition.path) as f:
            f.seek(partition.start)
            left = partition.size
            while left:
                data = f.read(min(left, BATCH * self.kind.itemsize))
                if not data or len(data) % self.kind.itemsize:
                    raise ValueError(f"{partition.path} ended early")
                left -= len(data)
                columns = widened(np.frombuffer(data, dtype=self.kind))
                if self.positions or self.ascending:
                    h = columns["h"]
                    before = np.concatenate([[h[0] if front is None else front], h[:-1]])
                    if self.ascending and (before.view(np.uint64) > h.view(np.uint64)).any():
                        raise ValueError(f"{partition.path} isn't in ascending order")
                    none = np.zeros(len(h), dtype=bool)
                    none[0] = front is None
                    if self.positions:
                        columns = {"pos": place + np.arange(len(h)), "h": h, "before": np.ma.array(before, mask=none)}
                    place, front = place + len(h), h[-1]
                yield self.batch(columns)

    def batch(self, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        if self.wanted:
            keep = np.logical_and.reduce([COMPARE[how](columns[c].astype(np.int64), value) for c, how, value in self.wanted])
            columns = {n: x[keep] for n, x in columns.items()}
        arrays = [pa.array(np.ma.getdata(x), mask=np.ma.getmaskarray(x)) if isinstance(x, np.ma.MaskedArray) else pa.array(x) for x in columns.values()]
        return pa.RecordBatch.from_arrays(arrays, list(columns))


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, kind: np.dtype, ordered: bool = False) -> None:
        self.uri, self.kind, self.ordered = uri, kind, ordered
        where, path = opened(uri)
        where.create_dir(path)
        if ordered and listed(uri):
            raise ValueError(f"{uri} isn't empty: a sorted folder is written once")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, path = opened(self.uri)
        message = WriterCommitMessage()
        message.part = TaskContext.get().partitionId()
        name = f"part-{message.part:07d}-{uuid.uuid4().hex}.bin"
        message.path, message.n, message.least, message.greatest = f"{path}/{name}", 0, 0, 0
        try:
            with where.open_output_stream(f"{message.path}.tmp") as f:
                for batch in batches:
                    rows = np.zeros(len(batch), dtype=self.kind)
                    for n in self.kind.names:
                        rows[n] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
                    if self.ordered and len(rows):
                        keys = rows["h"].view(np.uint64)
                        if (keys[:-1] > keys[1:]).any() or message.n and int(keys[0]) < message.greatest:
                            raise ValueError(f"part {message.part} isn't in ascending order")
                        message.least, message.greatest = message.least if message.n else int(keys[0]), int(keys[-1])
                    message.n += len(rows)
                    f.write(rows.tobytes())
        except BaseException:
            self.abort([message])
            raise
        return message

    def commit(self, messages: list) -> None:
        where, path = opened(self.uri)
        found = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        own = [m for m in found if m.n]
        if self.ordered and any(x.greatest > y.least for x, y in zip(own, own[1:], strict=False)):
            self.abort(found)
            raise ValueError("parts aren't in ascending order")
        for m in found:
            if m.n:
                where.move(f"{m.path}.tmp", m.path)
            else:
                where.delete_file(f"{m.path}.tmp")
        if self.ordered:
            with where.open_output_stream(f"{path}/{MANIFEST}") as f:
                f.write(json.dumps([{"name": m.path.rpartition("/")[2], "n": m.n, "least": m.least, "greatest": m.greatest} for m in own]).encode())

    def abort(self, messages: list) -> None:
        where, _ = opened(self.uri)
        for m in messages:
            if m is not None and where.get_file_info(f"{m.path}.tmp").type == fs.FileType.File:
                where.delete_file(f"{m.path}.tmp")


class Records(DataSource):
    kind: np.dtype

    def on(self, name: str) -> bool:
        return str(self.options.get(name, "")).lower() == "true"

    def reader(self, schema: object) -> RecordReader:
        uris = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return RecordReader(uris, self.kind, self.on("positions"), self.on("ascending"))

    def writer(self, schema: object, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], self.kind, self.on("sorted"))


class KeySource(Records):
    kind = KEY

    @classmethod
    def name(cls) -> str:
        return "xor_keys"

    def schema(self) -> str:
        return "pos long, h long, before long" if self.on("positions") else "h long"


class ShareSource(Records):
    kind = SHARE

    @classmethod
    def name(cls) -> str:
        return "xor_shares"

    def schema(self) -> str:
        return "kind short, difficulty short, extraNonce2 long, extraNonce1 long, nonce long, ntime long"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeySource)
    spark.dataSource.register(ShareSource)
