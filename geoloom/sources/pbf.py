"""OSM's binary format (PBF) as a Python data source: a task reads a run of the file's blobs.

The path must be one that driver and executors can open (a mounted folder)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of blobs that a task reads.
TASK_BYTES = 32 << 20
SCHEMAS = {
    "node": "id bigint, lat double, lon double, tags map<string,string>",
    "way": "id bigint, refs array<bigint>, tags map<string,string>",
    "relation": "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>",
}
MEMBERS = ("node", "way", "relation")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The field numbers and values of a protocol-buffer message, in order."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def running(data: bytes) -> list[int]:
    """Packed signed differences, summed up."""
    out, total = [], 0
    for n in numbers(data):
        total += signed(n)
        out.append(total)
    return out


def blobs(path: str) -> Iterator[tuple[int, int, str]]:
    """Offset, length and type of each blob."""
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            yield f.tell(), header[3], header[1].decode()
            f.seek(header[3], 1)


def block(data: bytes) -> bytes:
    blob = dict(fields(data))
    if 1 in blob:
        return blob[1]
    if 3 in blob:
        return zlib.decompress(blob[3])
    raise ValueError("a blob that is neither raw nor deflated")


def elements(data: bytes, kind: str) -> Iterator[tuple]:
    """The nodes, ways or relations of a block."""
    strings, groups, scale, lat0, lon0 = [], [], 100, 0, 0
    signed64 = lambda n: n - (1 << 64) if n >> 63 else n
    for number, value in fields(data):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            scale = value
        elif number == 19:
            lat0 = signed64(value)
        elif number == 20:
            lon0 = signed64(value)
    degrees = lambda offset, n: (offset + scale * n) / 1e9

    def tags(message: dict) -> dict:
        pairs = zip(numbers(message.get(2, b"")), numbers(message.get(3, b"")))
        out: dict[str, str] = {}
        for k, v in pairs:
            out.setdefault(strings[k], strings[v])
        return out

    for group in groups:
        for number, value in fields(group):
            if number == 1 and kind == "node":
                m = dict(fields(value))
                yield signed(m[1]), degrees(lat0, signed(m[8])), degrees(lon0, signed(m[9])), tags(m)
            elif number == 2 and kind == "node":
                m = dict(fields(value))
                said = iter(numbers(m.get(10, b"")))
                for i, y, x in zip(running(m[1]), running(m[8]), running(m[9]), strict=True):
                    own: dict[str, str] = {}
                    while k := next(said, 0):
                        own.setdefault(strings[k], strings[next(said)])
                    yield i, degrees(lat0, y), degrees(lon0, x), own
            elif number == 3 and kind == "way":
                m = dict(fields(value))
                yield signed64(m[1]), running(m.get(8, b"")), tags(m)
            elif number == 4 and kind == "relation":
                m = dict(fields(value))
                members = zip(numbers(m.get(10, b"")), running(m.get(9, b"")), numbers(m.get(8, b"")), strict=True)
                yield signed64(m[1]), [(MEMBERS[t], ref, strings[role]) for t, ref, role in members], tags(m)


class _Run(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[_Run]:
        runs, held, size = [], [], 0
        for at, length, kind in blobs(self.path):
            if kind != "OSMData":
                continue
            held.append((at, length))
            size += length
            if size >= TASK_BYTES:
                runs.append(_Run(held))
                held, size = [], 0
        return [*runs, _Run(held)]

    def read(self, partition: _Run) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for at, length in partition.places:
                f.seek(at)
                yield from elements(block(f.read(length)), self.kind)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("kind", "node"))


def scan_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a PBF file."""
    spark.dataSource.register(PbfSource)
    return tuple(spark.read.format("osmpbf").option("kind", kind).load(path) for kind in ("node", "way", "relation"))
