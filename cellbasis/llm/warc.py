"""WARC archives with revisit records, and a two-level capture index over them.

Archives are gzip members, one a record, so that a record is one range of bytes. The index has the captures sorted by
reversed-host URL key, in compressed blocks; each shard of it ends with a sparse directory that has the first
key of each block, and the shards' own first keys are the upper level. A look-up binary-searches the upper level, one
shard's directory and one block, and then reads a range of an archive. What a task holds is one directory and one
block; the upper level has one entry for each written partition.

Files go through Arrow's file systems by URI, so the shared folder can be any store that it opens. Their names are made
anew by each attempt; a lost attempt's files are never listed.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbasis.llm.common import attach, file_system, new_path, ready, written

LEAST_BYTES = 100  # smaller payloads are never stored as revisits
FILE_BYTES = 256 << 20  # an archive is closed once it has so many
BLOCK_CAPTURES = 512
READ_BYTES = 4 << 20  # neighbouring records are read together up to this
SHARD_CAPTURES = 1 << 20
PART_BYTES = 64 << 20  # of archives that a task reads back
NULL_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"  # pages have no time of capture

_CAPTURE = "surt string, page long, file string, start long, length long"
_SHARD = "surt string, page long, file string, captures long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ID = "urn:page:"


def surt(url: str | None) -> str:
    """The URL without scheme and with its host reversed: http://www.a.org/x gives org,a,www)/x. Null gives ''."""
    if not url:
        return ""
    head, found, rest = url.partition("://")
    if not found:
        rest = head
    n = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:n].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + rest[n:]
    return "".join(c if c > "\x1f" else f"%{ord(c):02X}" for c in key)


def _header(text: str) -> str:
    return "".join(c if c > "\x1f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed WARC record; with `refers_to`, a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    block = http + payload if refers_to is None else http
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:]), payload


def _id_in(field: str) -> int | None:
    said = field.removeprefix(f"<{_ID}").removesuffix(">")
    return int(said) if said else None


@dataclass
class Archive:
    """Where archives and index lie. `captures`: the capture table; `shards`: the index's upper level, sorted by key."""

    spark: SparkSession
    folder: str
    captures: DataFrame
    shards: list[tuple[tuple[bytes, int], str]]


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Write `pages` as WARC records and index them.

    Of records with equal payloads of at least 100 bytes, those with the smallest page_id are responses and the others
    revisits of it; smaller ones are all responses. Null html is an empty payload. A null page_id ranks behind every id.
    Repeated rows are records of their own, of the same type. Null URLs have the empty key.
    """
    spark = pages.sparkSession
    ready(spark)
    folder = new_path(spark, "warc")
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_BYTES
    same = plain.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = pages.count()
    joined = attach(plain, written(same.where("n > 1"), "same-payloads"), "digest", "n", total, F.col("page_id"))
    refers = F.when(large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(page_id, url, payload, digest, first)
                    out.write(data)
                    rows.append((surt(url), NULL_ID if page_id is None else page_id, name, at, len(data)))
                    at += len(data)
                yield _batch(rows, _CAPTURE)
        finally:
            if out is not None:
                out.close()

    captures = joined.select("page_id", "url", "payload", "digest", refers.alias("first")).mapInArrow(write, _CAPTURE)
    captures = written(captures, "captures")
    return Archive(spark, folder, captures, _index(captures, folder))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _parts(spark: SparkSession, needed: int) -> int:
    """Partitions of a range shuffle whose rows are small but stand for much work: as many as the work needs, and no fewer than the
    session shuffles into."""
    return max(1, needed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _index(captures: DataFrame, folder: str) -> list[tuple[tuple[bytes, int], str]]:
    """Write the index's shards, each a range of sorted captures; return the upper level."""
    parts = _parts(captures.sparkSession, -(-captures.count() // SHARD_CAPTURES))
    ordered = captures.repartitionByRange(parts, "surt", "page").sortWithinPartitions("surt", "page", "file", "start")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.cdx"
        directory: list[tuple[str, int, int, int]] = []
        pending: list[tuple] = []
        at = count = 0
        out = None

        def flush(rows: list[tuple]) -> None:
            nonlocal at, out, count
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode("utf-8"), 6)
            out.write(data)
            directory.append((rows[0][0], rows[0][1], at, len(data)))
            at += len(data)
            count += len(rows)

        for batch in batches:
            pending += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            while len(pending) >= BLOCK_CAPTURES:
                flush(pending[:BLOCK_CAPTURES])
                del pending[:BLOCK_CAPTURES]
        if pending:
            flush(pending)
        if out is not None:
            listed = zlib.compress(json.dumps(directory).encode("utf-8"), 6)
            out.write(listed + struct.pack("<QQ", at, len(listed)))
            out.close()
            yield _batch([(directory[0][0], directory[0][1], name, count)], _SHARD)

    rows = written(ordered.mapInArrow(write, _SHARD), "shards").collect()
    return sorted(((r.surt.encode("utf-8"), r.page), r.file) for r in rows)


class Reader:
    """Binary search through the index. Keeps the last shard's directory and the last block."""

    def __init__(self, folder: str, shards: list[tuple[tuple[bytes, int], str]]):
        self.fs, self.path = file_system(folder)
        self.shards = shards
        self.keys = [k for k, _ in shards]
        self.file = self.name = None
        self.directory: list[tuple[tuple[bytes, int], int, int]] = []
        self.at, self.block = None, []

    def _shard(self, k: int) -> None:
        if self.name != self.shards[k][1]:
            self.name, self.at = self.shards[k][1], None
            self.file = self.fs.open_input_file(f"{self.path}/{self.name}")
            size = self.file.size()
            start, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
            listed = json.loads(zlib.decompress(self.file.read_at(length, start)))
            self.directory = [((s.encode("utf-8"), p), a, n) for s, p, a, n in listed]

    def _block(self, k: int) -> None:
        if self.at != k:
            _, start, length = self.directory[k]
            lines = zlib.decompress(self.file.read_at(length, start)).decode("utf-8").split("\n")
            self.block = []
            for line in lines:
                s, page, name, at, n = line.split("\t")
                self.block.append(((s.encode("utf-8"), int(page)), name, int(at), int(n)))
            self.at = k

    def captures(self, low: tuple[bytes, int], high: tuple[bytes, int]) -> Iterator[tuple[int, str, int, int]]:
        """Page, file, start and length of every capture with a key from `low` to `high`."""
        if not self.shards:
            return
        # captures of one key may begin at the end of the shard or block before the one that its key opens
        k = max(0, bisect_left(self.keys, low) - 1)
        while k < len(self.shards) and self.keys[k] <= high:
            self._shard(k)
            firsts = [d[0] for d in self.directory]
            b = max(0, bisect_left(firsts, low) - 1)
            while b < len(firsts) and firsts[b] <= high:
                self._block(b)
                keys = [x[0] for x in self.block]
                for (_, page), name, at, n in self.block[bisect_left(keys, low) : bisect_right(keys, high)]:
                    yield page, name, at, n
                b += 1
            k += 1

    def of_url(self, url: str | None) -> list[tuple[int, str, int, int]]:
        key = surt(url).encode("utf-8")
        return list(self.captures((key, NULL_ID), (key, (1 << 63) - 1)))

    def read(self, name: str, start: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return parse(f.read_at(length, start))


def look_up(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The captures (page, file, start, length) of the distinct (page_id, url) of `wanted`, by the index."""
    folder, shards = archive.folder, archive.shards

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(surt(u), NULL_ID if p is None else p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield _batch(rows, "surt string, page long")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shards)
        for batch in batches:
            rows = []
            for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (s.encode("utf-8"), p)
                rows += reader.captures(key, key)
            yield _batch(rows, "page long, file string, start long, length long")

    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    asked = asked.mapInArrow(keys, "surt string, page long").distinct()
    parts = _parts(archive.spark, -(-archive.captures.count() // SHARD_CAPTURES))
    return asked.repartitionByRange(parts, "surt", "page").sortWithinPartitions("surt", "page").mapInArrow(find, "page long, file string, start long, length long")


def read_back(archive: Archive, found: DataFrame) -> DataFrame:
    """Read the records of `found` from the archives, neighbours together, and check payloads against their digests."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True))
            i = 0
            while i < len(wanted):
                j, (this, first, length) = i, wanted[i]
                end = first + length
                while j + 1 < len(wanted) and wanted[j + 1][0] == this and wanted[j + 1][1] == end and end - first < READ_BYTES:
                    j += 1
                    end += wanted[j][2]
                if this != name:
                    name, file = this, fs.open_input_file(f"{path}/{this}")
                data = file.read_at(end - first, first)
                for _, at, n in wanted[i : j + 1]:
                    rows.append(_summary(*parse(data[at - first : at - first + n])))
                i = j + 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    size = archive.captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    wanted = found.select("page", "file", "start", "length").repartitionByRange(_parts(archive.spark, -(-size // PART_BYTES)), "file", "start")
    return wanted.sortWithinPartitions("file", "start").mapInArrow(run, SCHEMA)


def _summary(fields: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http["Content-Length"])
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return _id_in(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _id_in(refers) if refers else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives, index them, look every page up by its key and read it back: SCHEMA's columns."""
    archive = write_archive(pages)
    return read_back(archive, look_up(archive, pages))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
