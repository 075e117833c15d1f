"""WARC records in ZIP-packaged archives, written once and read by ranges.

Writing: pages of equal payload are found by digest; the one of smallest id becomes a response record, the
others revisit it. Each task packs its records, each compressed alone, into archives: ZIP files whose
members are stored as they are, one with the records and one with their index. An archive has a name of its
own for each attempt, and only names that a finished task has returned are read.

Reading: the end of an archive gives its central directory, by way of the ZIP64 locator where there is one.
Directory entries and the local headers give the places of the stored members, and the index member those of
the records, which are then read by ranges, many tasks to an archive, without extracting anything.

Archives lie in the folder that executors share, and are reached through Arrow file systems. A task holds one
record and the index of one archive (rolled at ``ARCHIVE_BYTES``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import Steps, texts_of
from blockquery.sources.checkpoints import shared_folder

ARCHIVE_BYTES = 256 << 20
RUN = 256
"""Neighbouring records that one task reads together."""

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
URN = "urn:x-page:"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":/" in uri else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed WARC record: a response, or a revisit without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"] if revisit else []),
    ]
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> dict:
    """Page id, type, payload length and digest, and the page referred to, of one compressed record.

    The digest of a response is computed from its payload and must agree with the header.
    """
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(URN)
        return int(text) if text else None

    return {"page_id": page("WARC-Record-ID"), "payload_bytes": length, "payload_digest": told, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To")}


class _Archive:
    """A ZIP file in the making; records go straight to the stored member."""

    def __init__(self, folder: str):
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{path}/{uuid4().hex}.zip"
        self.out = files.open_output_stream(self.name)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, data: bytes) -> None:
        self.index.append((self.size, len(data)))
        self.size += self.member.write(data)

    def close(self) -> str:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in self.index))
        self.zip.close()
        self.out.close()
        return self.name


def directory(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Place and length of the stored members of a ZIP file, read from its end."""
    size = file.size()
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of a central directory")
    length, start = struct.unpack("<LL", tail[at + 12 : at + 20])
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR:
        end64 = file.read_at(56, struct.unpack("<Q", tail[locator + 8 : locator + 16])[0])
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        length, start = struct.unpack("<QQ", end64[40:56])
    listing, members, i = file.read_at(length, start), {}, 0
    while i < len(listing) and listing[i : i + 4] == ENTRY:
        method = struct.unpack("<H", listing[i + 10 : i + 12])[0]
        packed, full, names, extras, notes = struct.unpack("<LLHHH", listing[i + 20 : i + 34])
        offset = struct.unpack("<L", listing[i + 42 : i + 46])[0]
        name = listing[i + 46 : i + 46 + names].decode()
        extra, j = listing[i + 46 + names : i + 46 + names + extras], 0
        while j + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[j : j + 4])
            if kind == 1:  # the ZIP64 field holds, in this order, only the values that do not fit
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[j + 4 : j + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            j += 4 + n
        if method == 0:
            local = file.read_at(30, offset)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            members[name] = (offset + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        i += 46 + names + extras + notes
    return members


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``(page_id, url, html)``; returns ``(archive, records)``, lazily.

    NULL payloads are empty. Of equal payloads of at least ``min_bytes`` bytes the smallest ``page_id`` is the
    response; rows that repeat it are responses too, and so is every row of a group without any id. A row
    without an id revisits like others. Other columns are not read; an empty table writes nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    placed = rows.join(firsts, "digest", "left")
    refers = F.when(F.col("first").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page_id, url, data, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(folder)
                archive.add(record(page_id, url, data, first))
                if archive.size >= ARCHIVE_BYTES:
                    yield _row(archive)
                    archive = None
        if archive:
            yield _row(archive)

    return placed.select("page_id", "url", "payload", refers.cast("long").alias("first")).mapInArrow(run, "archive string, records long")


def _row(archive: _Archive) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive.close()]), pa.array([len(archive.index)], pa.int64())], ["archive", "records"])


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = file_system(folder)[0]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(name) as file:
                    members = directory(file)
                    start, length = members[INDEX]
                    base = members[RECORDS][0]
                    found = [json.loads(line) for line in file.read_at(length, start).splitlines()]
                columns = [[name] * len(found), [k // RUN for k in range(len(found))], [base + x["offset"] for x in found], [x["length"] for x in found]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "run", "start", "length"])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = file_system(folder)[0]
        name = file = None
        for batch in batches:
            out = []
            for archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, files.open_input_file(archive)
                out.append(parse(file.read_at(length, start)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if file:
            file.close()

    listed = archives.select("archive").mapInArrow(places, "archive string, run long, start long, length long")
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = listed.repartition(parts, "archive", "run").sortWithinPartitions("archive", "start")
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.select("archive", "start", "length").mapInArrow(records, kinds)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written into archives in the shared folder, and read back from there."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    archives = Steps(spark, "warc").keep(write_archives(pages, folder, min_bytes))
    return read_archives(archives, folder)
