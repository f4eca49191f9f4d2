"""Packet captures as a data source: spark.read.format("capture") for classic capture files, and a writer of them.

A file is read in splits. Its records have no marks to find them by, so a split begins at the first place from which CHAIN
records in a row (or all up to the end of the file) have plausible headers: lengths within the snapshot length and times
within a span of the file's first packet. The split before ends at the same place, found by the same rule; if its own
records don't lead there exactly, the read fails rather than lose or repeat a packet.

Rows: file, t (microseconds since 1970), src, dst (addresses, null where a packet has none), bytes (on the wire), captured.
Options: path (a file, or a folder of files), split (bytes, 32 MB), span (seconds, a year).
"""

from __future__ import annotations

import socket
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, t long, src string, dst string, bytes long, captured long"
CHAIN, ROWS = 48, 8192
# The magic numbers of both byte orders, with ticks of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
# Where the network layer's type and header begin, by link type (Ethernet, raw, cooked).
LINK = {1: (12, 14), 101: (None, 0), 113: (14, 16)}


def _opened(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def addresses(data: bytes, link: int) -> tuple[str | None, str | None]:
    """Source and destination of an IPv4 or IPv6 packet."""
    kind_at, at = LINK.get(link, (None, None))
    if at is None:
        return None, None
    if kind_at is None:
        version = data[0] >> 4 if data else 0
    else:
        kind = data[kind_at:at]
        while kind in (b"\x81\x00", b"\x88\xa8"):  # tags of virtual networks
            at += 4
            kind = data[at - 2:at]
        version = {b"\x08\x00": 4, b"\x86\xdd": 6}.get(kind, 0)
    if version == 4 and len(data) >= at + 20:
        return socket.inet_ntoa(data[at + 12:at + 16]), socket.inet_ntoa(data[at + 16:at + 20])
    if version == 6 and len(data) >= at + 40:
        return socket.inet_ntop(socket.AF_INET6, data[at + 8:at + 24]), socket.inet_ntop(socket.AF_INET6, data[at + 24:at + 40])
    return None, None


class File:
    """An open capture: its header's values, and records from a place on."""

    def __init__(self, path: str, span: int):
        where, name = _opened(path)
        self.path, self.size, self.handle, self.span = path, where.get_file_info(name).size, where.open_input_file(name), span
        head = self.handle.read_at(24, 0)
        if head[:4] not in MAGIC:
            raise ValueError(f"{path} is no classic capture file")
        order, self.ticks = MAGIC[head[:4]]
        self.record = struct.Struct(order + "IIII")
        self.snap, self.link = struct.unpack(order + "II", head[16:24])
        self.link &= 0xFFFF
        self.first = self.record.unpack(self.handle.read_at(16, 24))[0] if self.size >= 40 else 0

    def _plausible(self, data: bytes, at: int) -> int | None:
        """The length of the record whose header is at a place in data."""
        seconds, part, held, wire = self.record.unpack_from(data, at)
        ok = held <= wire and held <= max(self.snap, 1) and wire <= 1 << 20 and part < self.ticks and abs(seconds - self.first) <= self.span
        return 16 + held if ok else None

    def begin(self, at: int) -> int:
        """The first record's place at or after a place; the file's size if there is none."""
        if at <= 24:
            return 24
        reach = 1 << 20
        while at < self.size:
            data = self.handle.read_at(min(self.size - at, reach + CHAIN * (16 + min(self.snap, 1 << 18))), at)
            for k in range(min(reach, len(data))):
                if self._chain(data, k, at):
                    return at + k
            at += reach
        return self.size

    def _chain(self, data: bytes, k: int, at: int) -> bool:
        for _ in range(CHAIN):
            if at + k == self.size:
                return True
            if k + 16 > len(data):
                return at + len(data) < self.size  # a chain as long as what was read of it
            n = self._plausible(data, k)
            if n is None or at + k + n > self.size:
                return False
            k += n
        return True

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """The records from a place to another one."""
        at, data, base = start, b"", start
        while at < end:
            if at + 16 > base + len(data):
                data, base = self.handle.read_at(min(self.size - at, 4 << 20), at), at
            if at + 16 > base + len(data):
                return  # a header that the capture's end cut off
            seconds, part, held, wire = self.record.unpack_from(data, at - base)
            if at + 16 + held > base + len(data):
                if at + 16 + held > self.size:
                    return
                data, base = self.handle.read_at(max(16 + held, min(self.size - at, 4 << 20)), at), at
            body = data[at - base + 16:at - base + 16 + held]
            yield (self.path, seconds * 10**6 + part * 10**6 // self.ticks, *addresses(body, self.link), wire, held)
            at += 16 + held
        if at != end:
            raise ValueError(f"{self.path}: the records before byte {end} lead to byte {at}; read it with a larger split")


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.span = options["path"], int(options.get("split", 32 << 20)), int(options.get("span", 366 * 86400))

    def partitions(self) -> list[Split]:
        where, name = _opened(self.path)
        info = where.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else [i for i in where.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        prefix = self.path[:self.path.index(name)] if self.path.endswith(name) else ""
        return [Split(prefix + i.path, at, min(at + self.split, i.size)) for i in sorted(found, key=lambda i: i.path) for at in range(0, i.size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        f = File(partition.path, self.span)
        end = f.size if partition.end >= f.size else f.begin(partition.end)
        held: list[tuple] = []
        schema = pa.schema([("file", pa.string()), ("t", pa.int64()), ("src", pa.string()), ("dst", pa.string()), ("bytes", pa.int64()), ("captured", pa.int64())])
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
        for row in f.rows(f.begin(partition.start), end):
            held.append(row)
            if len(held) == ROWS:
                yield out()
                held = []
        if held:
            yield out()


class Wrote(WriterCommitMessage):
    pass


class Writer(DataSourceWriter):
    """A file for each task: rows (t, src, dst, bytes) as the headers of IPv4 packets in Ethernet frames, cut off after those."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Wrote:
        where, name = _opened(self.path)
        where.create_dir(name, recursive=True)
        part = f"{name}/{uuid.uuid4().hex}.pcap"
        with where.open_output_stream(f"{part}.tmp") as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for r in iterator:
                body = bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, min(max(r.bytes - 14, 20), 65535), 0, 0, 64, 17, 0) + socket.inet_aton(r.src) + socket.inet_aton(r.dst)
                f.write(struct.pack("<IIII", r.t // 10**6, r.t % 10**6, len(body), max(r.bytes, len(body))) + body)
        where.move(f"{part}.tmp", part)
        return Wrote()


class Capture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Capture)
