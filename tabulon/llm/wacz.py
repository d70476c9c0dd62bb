"""ZIP-packaged web archives: write WARC records into archives, read them back by range.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member a record), ``indexes/index.cdxj`` (a line a record with its offset and
length) and ``datapackage.json``.  Each writing task makes its own archives in
the shared folder and returns a row an archive; the written table of those rows
lists what counts, so files of a failed attempt are never read.

Reading never extracts a member.  A first task a file reads the end of the file,
the central directory (ZIP64 too), the local headers and the index, and emits
ranges of records; the ranges are dealt out evenly and each is one range read.

Of records with equal payloads the one with the smallest ``page_id`` is a
response and the others revisit it.  Defined results: a null html is an empty
payload; a null url is an empty target; rows that repeat the smallest page_id
are all responses; a null page_id is a response only if no id is known for its
payload; an empty table gives no archive and no row.  Other columns do not take
part.  Archives are opened through ``pyarrow.fs``, so the shared folder must be
of a kind it knows (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import hot_aware_join, read_table, shared_dir, written
from tabulon.session import ship_package

ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task starts its next archive
TASK_RANGES = 64          # ranges that one task reads, at most, on large archives
RANGE_BYTES = 1 << 20     # compressed bytes of a range of records

# Fixed values of the ZIP format: signatures and sizes of its parts.
END_SIGNATURE, END_SIZE = b"PK\x05\x06", 22
LOCATOR_SIGNATURE, LOCATOR_SIZE = b"PK\x06\x07", 20
END64_SIGNATURE, END64_SIZE = b"PK\x06\x06", 56
ENTRY_SIGNATURE, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL_SIGNATURE, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- ZIP directory
def read_end(file) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory of an open random-access file."""
    size = file.size()
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = file.read_at(size - tail_at, tail_at)

    def is_end(at: int) -> bool:  # else these bytes stand in the comment
        return at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)

    at = tail.rfind(END_SIGNATURE)
    while at >= 0 and not is_end(at):
        at = tail.rfind(END_SIGNATURE, 0, at + 3)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (length, offset):
        locator = file.read_at(LOCATOR_SIZE, tail_at + at - LOCATOR_SIZE)
        if locator[:4] != LOCATOR_SIGNATURE:
            raise ValueError("no locator of the ZIP64 directory's end")
        end = file.read_at(END64_SIZE, struct.unpack_from("<Q", locator, 8)[0])
        if end[:4] != END64_SIGNATURE:
            raise ValueError("no end of the ZIP64 directory")
        entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    return offset, length, entries


def read_directory(file) -> dict[str, dict]:
    """Members by name: method, size (compressed), full_size and header (offset of the local header)."""
    offset, length, entries = read_end(file)
    data = file.read_at(length, offset)
    members, at = {}, 0
    for _ in range(entries):
        if data[at: at + 4] != ENTRY_SIGNATURE:
            raise ValueError("a broken ZIP directory")
        method, = struct.unpack_from("<H", data, at + 10)
        size, full_size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + ENTRY_SIZE: at + ENTRY_SIZE + n_name].decode("utf-8", "replace")
        extra = data[at + ENTRY_SIZE + n_name: at + ENTRY_SIZE + n_name + n_extra]
        x = 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:  # only the fields that do not fit stand here, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                full_size = wide.pop(0) if full_size == FULL32 else full_size
                size = wide.pop(0) if size == FULL32 else size
                header = wide.pop(0) if header == FULL32 else header
            x += 4 + n
        members[name] = {"method": method, "size": size, "full_size": full_size, "header": header}
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return members


def data_start(file, member: dict) -> int:
    head = file.read_at(LOCAL_SIZE, member["header"])
    if head[:4] != LOCAL_SIGNATURE:
        raise ValueError("no local header where the directory says")
    return member["header"] + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))


def member_bytes(file, member: dict) -> bytes:
    raw = file.read_at(member["size"], data_start(file, member))
    return zlib.decompress(raw, -15) if member["method"] == 8 else raw


# ---------------------------------------------------------------- records
def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool) -> bytes:
    """One WARC record, gzipped.  A revisit keeps the HTTP header of the full payload, but no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if is_response else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if not is_response:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and payload_digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record where the index says")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != told:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
            "refers_to": None if response else _page(fields["warc-refers-to"]), "payload": payload if response else None,
            "payload_bytes": len(payload) if response else int(_fields(http)["content-length"]), "payload_digest": told}


class _Archive:
    """An archive that grows record by record and is written once to a stream."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = _filesystem(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.index, self.at, self.records, self.payload = io.BytesIO(), 0, 0, 0

    def add(self, raw: bytes, page_id, payload: int) -> None:
        self.member.write(raw)
        self.index.write(f"{_urn(page_id)} {json.dumps({'filename': 'data.warc.gz', 'offset': self.at, 'length': len(raw)})}\n".encode())
        self.at += len(raw)
        self.records += 1
        self.payload += payload

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", self.index.getvalue())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": ["archive/data.warc.gz", "indexes/index.cdxj"]}))
        self.zip.close()
        self.out.close()
        return self.uri, self.records


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, done = TaskContext.get().partitionId(), None, []
        for b in batches:
            for page_id, url, html, digest, first in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                payload = (html or "").encode()
                if archive is None:
                    archive = _Archive(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.wacz")
                told = base64.b32encode(bytes.fromhex(digest)).decode()
                archive.add(record(page_id, url, payload, told, first, first is None or first == page_id), page_id, len(payload))
                if archive.payload >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())],
                                         names=["path", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages into archives below ``folder``; a row (path, records) an archive."""
    ship_package(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    src = src.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    groups = written(src.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    total = pages.count()
    hot = groups.where(F.col("n") >= total / 1000.0)  # at most 1,000 payloads
    joined = hot_aware_join(src, groups.select("digest", "first"), ["digest"], hot, ["page_id", "url"])
    # a payload that occurs once is a response: ``first`` is null
    return written(joined.select("page_id", "url", "html", "digest", "first").mapInArrow(_writer(folder), "path string, records long"), "archives")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directory and index of each archive -> ranges of consecutive records."""
    for b in batches:
        out = []
        for uri in b.column("path").to_pylist():
            system, path = _filesystem(uri)
            with system.open_input_file(path) as file:
                members = read_directory(file)
                index = member_bytes(file, members["indexes/index.cdxj"])
                data = next(m for name, m in members.items() if name.startswith("archive/"))
                if data["method"] != 0:
                    raise ValueError("records can be read by range from stored members only")
                base, lengths, start = data_start(file, data), [], 0
                for line in index.splitlines():
                    place = json.loads(line[line.index(b"{"):])
                    if lengths and (place["offset"] != start + sum(lengths) or sum(lengths) >= RANGE_BYTES):
                        out.append((uri, base + start, lengths))
                        lengths = []
                    start = start if lengths else place["offset"]
                    lengths.append(place["length"])
                if lengths:
                    out.append((uri, base + start, lengths))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                          pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["path", "start", "lengths"])


RECORD_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
                 "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
                 "payload_digest string")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, start, lengths in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            system, path = _filesystem(uri)
            with system.open_input_file(path) as file:
                raw = file.read_at(sum(lengths), start)
            found, at = [], 0
            for n in lengths:
                found.append(parse_record(raw[at: at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in RECORD_FIELDS.items()], names=list(RECORD_FIELDS))


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives named in column ``path``: directory, index, then range reads dealt out evenly."""
    ship_package(archives.sparkSession)
    ranges = written(archives.select("path").mapInArrow(_ranges, "path string, start long, lengths array<int>"), "ranges")
    # an explicit number of tasks: the rows are tiny, the records behind them are not
    count = ranges.count()
    least = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks = max(1, min(count, max(least, -(-count // TASK_RANGES))))
    return ranges.repartition(tasks, F.col("path"), F.col("start")).mapInArrow(_records, RECORD_SCHEMA)


def op5_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read_table(spark, sf_dir, "pages"), shared_dir(spark, "wacz"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
