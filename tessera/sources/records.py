"""Keyed record files as a Spark data source: framed records with checksums, an index by key, and a pushed-down key filter.

    spark.dataSource.register(RecordSource)
    df.select("key", "value").write.format("keyed_records").mode("append").save(folder)
    spark.read.format("keyed_records").load(folder).filter("key = 'a7'")

A task writes one file of frames (TFRecord framing: length, its masked CRC-32C, data, its masked CRC-32C; data is the key's
length, the key and the value) and an index of fixed entries sorted by the key's hash. The manifest names the files that count,
so what a lost or repeated task leaves behind isn't read. With an equality or IN on the key a file whose range of hashes
can hold it is searched by bisection and only the frames found are read. A frame whose data fail their checksum has a null
value (and, in a scan, a null key); one whose length fails it ends the scan of its split, as nothing says where the next begins.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: The reversed Castagnoli polynomial and the constant that masks a checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
SPLIT_BYTES = 64 << 20
ENTRY = struct.Struct("<QQ")  # hash of the key, offset of the frame
HEAD = struct.Struct("<QI")
MANIFEST = "_records.json"


def _tables() -> list[list[int]]:
    """Eight tables of 256 by the rule: the first shifts a byte through the polynomial, each next one a byte more."""
    first = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (POLYNOMIAL if x & 1 else 0)
        first.append(x)
    out = [first]
    for _ in range(7):
        out.append([first[x & 255] ^ x >> 8 for x in out[-1]])
    return out


_T = _tables()


def crc32c(data: bytes) -> int:
    a, b, c, d, e, f, g, h = reversed(_T)
    x, end = 0xFFFFFFFF, len(data) & ~7
    for lo, hi in struct.iter_unpack("<II", data[:end]):
        lo ^= x
        x = a[lo & 255] ^ b[lo >> 8 & 255] ^ c[lo >> 16 & 255] ^ d[lo >> 24] ^ e[hi & 255] ^ f[hi >> 8 & 255] ^ g[hi >> 16 & 255] ^ h[hi >> 24]
    for v in data[end:]:
        x = h[(x ^ v) & 255] ^ x >> 8
    return x ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    x = crc32c(data)
    return (x >> 15 | x << 17 & 0xFFFFFFFF) + MASK & 0xFFFFFFFF


def key_hash(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")


def _fs(path: str):
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return None, u.path or path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _read(path: str):
    fs, p = _fs(path)
    return open(p, "rb") if fs is None else fs.open_input_file(p)


def _write(path: str):
    fs, p = _fs(path)
    if fs is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        return open(p, "wb")
    fs.create_dir(os.path.dirname(p), recursive=True)
    return fs.open_output_stream(p)


def _manifest(folder: str) -> list[dict]:
    try:
        with _read(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return []


def frame(key: str, value: bytes) -> bytes:
    k = key.encode()
    data = struct.pack("<I", len(k)) + k + value
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def read_frame(f) -> tuple[bool, tuple[str, bytes] | None] | None:
    """(whether the next frame's place is known, (key, value) or None for bad data); None at the end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        return False, None
    size = HEAD.unpack(head)[0]
    data, check = f.read(size), f.read(4)
    if len(check) < 4 or masked(data) != struct.unpack("<I", check)[0]:
        return len(check) == 4, None
    n = struct.unpack("<I", data[:4])[0]
    return True, (data[4 : 4 + n].decode(), data[4 + n :])


def find(index: str, wanted: int) -> Iterator[int]:
    """Offsets of the frames with this hash, by bisection over the entries of an index."""
    with _read(index) as f:
        f.seek(0, 2)
        lo, hi = 0, f.tell() // ENTRY.size
        n = hi

        def at(i: int) -> tuple[int, int]:
            f.seek(i * ENTRY.size)
            return ENTRY.unpack(f.read(ENTRY.size))

        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if at(mid)[0] < wanted else (lo, mid)
        while lo < n and (entry := at(lo))[0] == wanted:
            yield entry[1]
            lo += 1


class Split(InputPartition):
    def __init__(self, file: str, start: int, end: int, keys: list[str] | None):
        self.file, self.start, self.end, self.keys = file, start, end, keys


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.keys = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if isinstance(x, (EqualTo, In)) and tuple(x.attribute) == ("key",):
                asked = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.keys = sorted(asked if self.keys is None else asked & set(self.keys))
            else:
                yield x

    def partitions(self) -> list[Split]:
        out = []
        for m in _manifest(self.folder):
            file = f"{self.folder}/{m['file']}"
            if self.keys is None:
                out += [Split(file, a, b, None) for a, b in zip(m["splits"], m["splits"][1:], strict=False)]
            elif keys := [k for k in self.keys if m["least"] <= key_hash(k) <= m["most"]]:
                out.append(Split(file, 0, 0, keys))
        return out or [Split("", 0, 0, [])]

    def read(self, split: Split) -> Iterator[tuple]:
        if split.keys is not None:
            for k in split.keys:
                for offset in find(f"{split.file}.index", key_hash(k)):
                    with _read(split.file) as f:
                        f.seek(offset)
                        got = read_frame(f)
                    if got is None or got[1] is None:
                        yield k, None
                    elif got[1][0] == k:
                        yield got[1]
            return
        with _read(split.file) as f:
            f.seek(split.start)
            while f.tell() < split.end and (got := read_frame(f)):
                yield got[1] or (None, None)
                if not got[0]:
                    return


class Written(WriterCommitMessage):
    def __init__(self, entry: dict | None):
        self.entry = entry


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, split: int):
        self.folder, self.overwrite, self.split = folder, overwrite, split

    def write(self, rows: Iterator) -> Written:
        name, at, entries, splits = f"part-{uuid.uuid4().hex}.records", 0, [], [0]
        out = None
        for key, value in rows:
            if key is None:
                raise ValueError("a record needs a key")
            out = out or _write(f"{self.folder}/{name}")
            data = frame(key, bytes(value or b""))
            out.write(data)
            entries.append((key_hash(key), at))
            at += len(data)
            if at - splits[-1] >= self.split:
                splits.append(at)
        if out is None:
            return Written(None)
        out.close()
        entries.sort()
        with _write(f"{self.folder}/{name}.index") as f:
            f.write(b"".join(ENTRY.pack(*e) for e in entries))
        return Written({"file": name, "n": len(entries), "least": entries[0][0], "most": entries[-1][0], "splits": splits if splits[-1] == at else [*splits, at]})

    def commit(self, messages: list) -> None:
        listed = ([] if self.overwrite else _manifest(self.folder)) + [m.entry for m in messages if m and m.entry]
        with _write(f"{self.folder}/{MANIFEST}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(listed).encode())
            tmp = f.name if hasattr(f, "name") else None
        if tmp:
            os.replace(tmp, _fs(f"{self.folder}/{MANIFEST}")[1])
        else:
            with _write(f"{self.folder}/{MANIFEST}") as f:
                f.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        """Files of an aborted write are in no manifest."""


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_records"

    def schema(self) -> str:
        return "key string, value binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), overwrite, int(self.options.get("splitbytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
