"""Record containers as a Spark data source: records one after the other, then a table of their ends.

A file is the concatenated records, then for each record its end as a little-endian 64-bit number; the last of these
is also where the table begins. In files named .bagz each record is a zstandard frame. ``spark.dataSource.register(BagSource)``, then
``spark.read.format("bag").load(folder)``. Files are cut into ranges of records, so a large one is read by many tasks, each
of which reads the ends and bytes of its range only. Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VALUE_SCHEMA = "fen string, move string, win_prob double"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]:", "s3:", path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_bag(path: str, records: list[bytes]) -> None:
    """A small container written in one go; .bagz compresses."""
    if path.endswith(".bagz"):
        import zstandard

        records = [zstandard.compress(r) for r in records]
    ends, at = [], 0
    for r in records:
        at += len(r)
        ends.append(at)
    system, name = opened(path)
    with system.open_output_stream(name) as out:
        out.write(b"".join(records) + struct.pack(f"<{len(ends)}Q", *ends))


def encode_value(fen: str, move: str, win_prob: float) -> bytes:
    """Two texts, each after its length in 7-bit groups, and a big-endian double."""
    out = b""
    for text in (fen, move):
        data = text.encode()
        n, head = len(data), b""
        while n > 127:
            head, n = head + bytes([n & 127 | 128]), n >> 7
        out += head + bytes([n]) + data
    return out + struct.pack(">d", win_prob)


def decode_value(record: bytes) -> tuple[str, str, float]:
    at, texts = 0, []
    for _ in range(2):
        n = shift = 0
        while True:
            byte = record[at]
            n, at, shift = n | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                break
        texts.append(record[at : at + n].decode())
        at += n
    return texts[0], texts[1], struct.unpack_from(">d", record, at)[0]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class BagReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, shards: tuple[int, int] | None, rows: int) -> None:
        self.path, self.pattern, self.shards, self.rows = path, pattern, shards, rows

    def files(self) -> list[str]:
        system, name = opened(self.path)
        prefix = self.path[: -len(name)] if self.path.endswith(name) else ""
        info = system.get_file_info(name)
        names = [name] if info.type == pafs.FileType.File else sorted(f.path for f in system.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File and fnmatch(f.base_name, self.pattern))
        if not names:
            raise FileNotFoundError(f"no file in {self.path} matches {self.pattern}")
        return [prefix + n for n in (names[slice(*self.shards)] if self.shards else names)]

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files():
            system, name = opened(path)
            with system.open_input_file(name) as f:
                size = f.size()
                n = (size - struct.unpack("<Q", f.read_at(8, size - 8))[0]) // 8 if size else 0
            out += [Range(path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, name = opened(part.path)
        with system.open_input_file(name) as f:
            size = f.size()
            table = struct.unpack("<Q", f.read_at(8, size - 8))[0]
            low = max(0, part.start - 1)
            ends = struct.unpack(f"<{part.end - low}Q", f.read_at(8 * (part.end - low), table + 8 * low))
            cuts = ends if part.start else (0, *ends)
            data = f.read_at(cuts[-1] - cuts[0], cuts[0])
        records = [data[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if part.path.endswith(".bagz"):
            import zstandard

            records = [zstandard.decompress(r) for r in records]
        rows = [decode_value(r) for r in records]
        for a in range(0, len(rows), 10000):
            columns = list(zip(*rows[a : a + 10000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["fen", "move", "win_prob"])


class BagSource(DataSource):
    """Options: pathGlobFilter (default *.bag*), shards (as 0-500: that range of the sorted files), rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return VALUE_SCHEMA

    def reader(self, schema: object) -> BagReader:
        from .files import parse_range

        shards = self.options.get("shards")
        return BagReader(self.options["path"], self.options.get("pathGlobFilter", "*.bag*"), parse_range(shards) if shards else None, int(self.options.get("rowsPerTask", 1 << 20)))
