"""WARC records in ZIP-packaged archives, read by byte range without extraction.

An archive is a ZIP whose members are stored: archive/data.warc.gz (one gzip member per record) and indexes/index.cdx
(one JSON line per record: page_id, offset, length within the WARC member). The reader below parses the end-of-directory
records (ZIP64 too) and the central directory itself, and reads single records by their range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, fresh_path, lean, materialize, open_range, small_batches

#: Signatures of the ZIP format (fixed values).
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
MIN_REVISIT = 100


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def _at(f, pos: int, n: int) -> bytes:
    f.seek(pos)
    b = f.read(n)
    if len(b) < n:
        raise ValueError(f"archive ends at {pos + len(b)}, {n} bytes wanted at {pos}")
    return b


def central_directory(f) -> dict[str, Member]:
    """Members by name, from the central directory; ZIP64 records and extra fields are followed where 32-bit ones are full."""
    end = f.seek(0, 2)
    back = min(end, 22 + FULL16)
    tail = _at(f, end - back, back)
    at = tail.rfind(EOCD)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    total, size, start = struct.unpack_from("<HII", tail, at + 10)
    eocd = end - back + at
    if FULL16 == total or FULL32 in (size, start):
        sig, _, where, _ = struct.unpack("<4sIQI", _at(f, eocd - 20, 20))
        if sig != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        head = _at(f, where, 56)
        if head[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        total, size, start = struct.unpack_from("<QQQ", head, 32)
    data, pos, out = _at(f, start, size), 0, {}
    for _ in range(total):
        if data[pos : pos + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, pos + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, pos + 20)
        (header,) = struct.unpack_from("<I", data, pos + 42)
        name = data[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = data[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            q += 4 + n
        out[name] = Member(name, method, full, packed, header)
        pos += 46 + n_name + n_extra + n_comment
    return out


def member_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} is compressed; its records can't be read by range")
    head = _at(f, m.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def header_value(x: str) -> str:
    """x with control characters and line separators as percent escapes, since a header ends at a line's end."""
    return re.sub("[\x00-\x1f\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), x)


def warc_record(kind: str, page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload. The id is made from page_id and digest, so a rerun writes the same."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>", f"WARC-Target-URI: {header_value(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, kind, refers_to. Of equal payloads of MIN_REVISIT bytes at least, the smallest page_id
    is the response. Only (digest, page_id) is aggregated, with a partial sum per task; a very common payload is one row
    there, and the join back is one that adaptive execution can split."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    first = p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("n") >= MIN_REVISIT) & (F.col("page_id") != F.col("first_id"))
    return p.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str) -> DataFrame:
    """Write a record per page into ZIP archives under out; returns the written table of archives (path, n_records).

    A null html is an empty payload, a null url an empty URI, a null page_id is written as an empty id and never answers
    for others. Control characters of a URL are written as percent escapes. Repeated rows are records each; rows with equal
    page_id and payload are all responses. Other columns are not read. An empty table gives no archive. Archives hold one
    task's rows, are named by its partition and are renamed into place when whole, so that a task run again leaves one.
    Very long pages are compressed one at a time.
    """
    small_batches(pages.sparkSession)
    rows = classify(pages).withColumns({"page_id": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "refers_to": F.col("refers_to").cast("string")})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = None
        for b in batches:
            if f is None and len(b):
                f = AtomicFile(path := f"{out}/part-{TaskContext.get().partitionId():06d}.wacz")
                z = zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = z.open(zipfile.ZipInfo(WARC_MEMBER, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
                index, at = [], 0
            for pid, url, html, digest, kind, ref in b.itertuples(index=False, name=None):
                rec = gzip.compress(warc_record(kind, pid, url or "", html.encode("utf-8"), digest, ref if isinstance(ref, str) else None), 1, mtime=0)
                data.write(rec)
                index.append(json.dumps({"page_id": pid, "offset": at, "length": len(rec)}))
                at += len(rec)
        if f is not None:
            data.close()
            z.writestr(zipfile.ZipInfo(INDEX_MEMBER, (1980, 1, 1, 0, 0, 0)), "\n".join(index))
            z.close()
            f.commit()
            yield pd.DataFrame({"path": [path], "n_records": [len(index)]})

    return materialize(rows.mapInPandas(lean(write), "path string, n_records long"), "archives")


def read_records(archives: DataFrame, batch: int = 500) -> DataFrame:
    """page_id, url, record_type, payload_digest (of the record's header), payload_bytes, refers_to, payload (null for a
    revisit) of each record: the directory gives the members, the index the ranges."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    num = lambda x: int(x) if x else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with open_range(path) as f:
                    members = central_directory(f)
                    start, index = member_start(f, members[WARC_MEMBER]), members[INDEX_MEMBER]
                    rows = []
                    for line in _at(f, member_start(f, index), index.stored).decode().split("\n"):
                        where = json.loads(line)
                        fields, body = parse_record(gzip.decompress(_at(f, start + where["offset"], where["length"])))
                        kind = fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload of page {where['page_id']} in {path} doesn't match its digest")
                        rows.append((num(fields["x-page-id"]), fields["warc-target-uri"], kind, digest, int(fields["x-payload-length"]), num(fields.get("x-refers-to-page")), body if kind == "response" else None))
                        if len(rows) >= batch:
                            yield _frame(rows)
                            rows = []
                    if rows:
                        yield _frame(rows)

    n = min(archives.count(), 4096)
    return archives.select("path").repartition(max(1, n)).mapInPandas(lean(read), schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    # a column of numbers and nulls would become one of floats
    return pd.DataFrame({n: pd.array(list(v), dtype="Int64") if n in ("page_id", "refers_to") else list(v) for n, v in zip(names, zip(*rows, strict=True), strict=True)})


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written to archives and read back; nulls, empty and very long pages, repeats as write_archives() says."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
