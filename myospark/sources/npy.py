"""A Python data source for stacks of frames in `.npy` files, read by byte ranges.

The driver reads the headers alone and plans partitions of frames, a part of a stack each, so a stack of any size is many
tasks; comparisons of `frame` with numbers leave out frames before any is planned, and a task reads the bytes of its own
frames, one frame at a time.
"""

from __future__ import annotations

import struct
from ast import literal_eval
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from ..storage import absolute, store

SCHEMA = "path string, frame int, height int, width int, channels int, pixels array<double>"
#: Bytes of a partition; headers read at once; the magic bytes of the format.
PART_BYTES, THREADS, MAGIC = 64 << 20, 16, b"\x93NUMPY"


@dataclass
class Stack:
    path: str
    start: int  # of the first frame
    kind: str
    shape: tuple[int, int, int, int]  # frames, height, width, channels

    @property
    def frame_bytes(self) -> int:
        return int(np.prod(self.shape[1:])) * np.dtype(self.kind).itemsize


def read_header(f, path: str) -> Stack:
    """The stack in an open file. Stacks that need unpickling, of other than 3 or 4 dimensions or stored column by column are refused."""
    head = f.read(12)
    if head[:6] != MAGIC:
        raise ValueError(f"{path} is no .npy file")
    long = head[6] > 1
    start = 12 if long else 10
    (size,) = struct.unpack("<I", head[8:12]) if long else struct.unpack("<H", head[8:10])
    text = head[start:] + f.read(start + size - 12)
    told = literal_eval(text.decode("utf-8" if head[6] > 2 else "latin-1"))
    kind = np.lib.format.descr_to_dtype(told["descr"])
    shape = told["shape"]
    if kind.hasobject or kind.fields:
        raise ValueError(f"{path} does not hold plain numbers")
    if len(shape) not in (3, 4):
        raise ValueError(f"a stack has 3 or 4 dimensions, not {len(shape)}: {path}")
    if told["fortran_order"] and sum(n > 1 for n in shape) > 1:
        raise ValueError(f"{path} is stored column by column: its frames lie in no range of bytes")
    return Stack(path, start + size, kind.str, (*shape, 1)[:4])


@dataclass
class Range(D.InputPartition):
    """Frames [first, last) of a stack."""

    stack: Stack
    first: int
    last: int

    def __init__(self, stack: Stack, first: int, last: int):
        super().__init__(None)
        self.stack, self.first, self.last = stack, first, last


class NpyReader(D.DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Bounds of `frame` are kept to here; all others go back to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            whole = isinstance(value, int) or isinstance(f, D.In) and all(isinstance(v, int) for v in f.value)
            if getattr(f, "attribute", None) != ("frame",) or not whole:
                yield f
            elif isinstance(f, D.EqualTo):
                self.keep({value})
            elif isinstance(f, D.In):
                self.keep(set(f.value))
            elif isinstance(f, D.GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, D.GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, D.LessThan):
                self.high = value if self.high is None else min(self.high, value)
            elif isinstance(f, D.LessThanOrEqual):
                self.high = value + 1 if self.high is None else min(self.high, value + 1)
            else:
                yield f

    def keep(self, frames: set[int]) -> None:
        self.only = frames if self.only is None else self.only & frames

    def wanted(self, frames: int) -> list[tuple[int, int]]:
        """The runs of frames that the filters leave of so many."""
        low, high = self.low, frames if self.high is None else min(frames, self.high)
        if self.only is None:
            return [(low, high)] if low < high else []
        runs: list[tuple[int, int]] = []
        for k in sorted(k for k in self.only if low <= k < high):
            if runs and runs[-1][1] == k:
                runs[-1] = (runs[-1][0], k + 1)
            else:
                runs.append((k, k + 1))
        return runs

    def partitions(self) -> list[Range]:
        def header(path: str) -> Stack:
            where, own = store(path)
            with where.open_input_file(own) as f:
                return read_header(f, path)

        with ThreadPoolExecutor(THREADS) as threads:
            stacks = list(threads.map(header, files(self.path)))
        out = []
        for s in stacks:
            step = max(1, self.part_bytes // max(1, s.frame_bytes))
            out += [Range(s, k, min(b, k + step)) for a, b in self.wanted(s.shape[0]) for k in range(a, b, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where nothing is planned
            return
        s = part.stack
        where, own = store(s.path)
        with where.open_input_file(own) as f:
            f.seek(s.start + part.first * s.frame_bytes)
            for k in range(part.first, part.last):
                data = f.read(s.frame_bytes)
                if len(data) < s.frame_bytes:
                    raise ValueError(f"{s.path} ends within frame {k}")
                values = np.frombuffer(data, s.kind).astype(float)
                pixels = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                numbers = [pa.array([n], pa.int32()) for n in (k, *s.shape[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([s.path]), *numbers, pixels], names=["path", "frame", "height", "width", "channels", "pixels"])


def files(path: str) -> list[str]:
    """The .npy files at or under path, by name."""
    from pyarrow import fs

    where, own = store(path)
    info = where.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(own, recursive=True))
    before = path[: len(path) - len(own)] if path.endswith(own) else ""
    return sorted(before + f.path for f in found if f.is_file and f.path.endswith(".npy"))


class NpySource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("partbytes", PART_BYTES)))


def scan_npy(spark: SparkSession, path: str, part_bytes: int = PART_BYTES):
    """(path, frame, height, width, channels, pixels) of all stacks at or under path. The filters are pushed down."""
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy").option("partbytes", str(part_bytes)).load(absolute(spark, path))
