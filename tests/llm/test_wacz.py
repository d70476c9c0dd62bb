"""Archives: directories (ZIP64 too) and records against the standard library and plain Python."""

import base64
import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest

from tabulon.llm.wacz import (
    data_start, member_bytes, parse_record, read_archives, read_directory, read_end, record, write_archives)


class File:
    """A byte string with the two methods of a random-access file that the reader uses."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


def zipped(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **options) as z:
        for name, data, method in members:
            z.writestr(name, data, method)
        z.comment = b"PK\x05\x06 in a comment"
    return out.getvalue()


def test_directory_of_a_plain_archive():
    members = [("archive/data.warc.gz", b"0123456789" * 9, zipfile.ZIP_STORED), ("indexes/é", b"index" * 50, zipfile.ZIP_DEFLATED)]
    f = File(zipped(members))
    found = read_directory(f)
    assert [(n, member_bytes(f, found[n])) for n in found] == [(n, d) for n, d, _ in members]
    at = data_start(f, found["archive/data.warc.gz"])
    assert f.read_at(5, at + 10) == b"01234"


def test_zip64_directory():
    """An archive whose end, sizes and offset stand in ZIP64 records only."""
    body, name = b"payload", b"archive/x"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = File(local + body + entry + end64 + locator + end)
    assert read_end(f) == (start, len(entry), 1)
    found = read_directory(f)["archive/x"]
    assert member_bytes(f, found) == body and found["header"] == 0


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        read_end(File(b"no archive at all"))
    with pytest.raises(ValueError):
        read_directory(File(zipped([("a", b"x", 0)]).replace(b"PK\x01\x02", b"PK\x09\x09")))


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    r = parse_record(record(7, "http://x/\r\ny", payload, digest, None, True))
    assert (r["page_id"], r["payload"], r["record_type"], r["url"]) == (7, payload, "response", "http://x/%0D%0Ay")
    r = parse_record(record(8, None, payload, digest, 7, False))
    assert (r["refers_to"], r["payload"], r["payload_bytes"], r["payload_digest"]) == (7, None, len(payload), digest)
    with pytest.raises(ValueError):
        parse_record(record(7, "u", payload, "A" * 32, None, True))


def test_pages_come_back(spark, tmp_path):
    html = ["<p>one</p>", "", None, "<p>one</p>", "long " * 60000, "é", "<p>one</p>"] + ["same"] * 60
    rows = [(100 - k, f"http://h/{k}", t, "k") for k, t in enumerate(html)] + [(None, "u", "only", "k"), (None, None, "same", "k"), (3000, "v", "same", "k"), (41, "again", "same", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    back = read_archives(write_archives(df, f"file://{tmp_path}/w")).collect()
    assert len(back) == len(rows)
    least = {}
    for p, _, t, _ in rows:
        if p is not None:
            least[t or ""] = min(least.get(t or "", p), p)
    want = []
    for p, u, t, _ in rows:
        data, first = (t or "").encode(), least.get(t or "")
        response = first is None or first == p
        want.append((p, u or "", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if response else "revisit", None if response else first))
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r["payload"] is not None and len(r["payload"]) == r["payload_bytes"] for r in back if r["record_type"] == "response")


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(df, f"file://{tmp_path}/w")).count() == 0


def test_several_archives_a_task(spark, tmp_path, monkeypatch):
    import tabulon.llm.wacz as module
    from pyspark import TaskContext
    monkeypatch.setattr(module, "ARCHIVE_BYTES", 10)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    rows = pa.RecordBatch.from_pylist([{"page_id": k, "url": "u", "html": "abcdefgh", "digest": hashlib.sha1(b"abcdefgh").hexdigest(), "first": 0} for k in range(6)],
                                      schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string()), ("first", pa.int64())]))
    paths = [p for b in module._writer(f"file://{tmp_path}/a")(iter([rows])) for p in b.column("path").to_pylist()]
    assert len(paths) == 3
    ranges = list(module._ranges(iter([pa.RecordBatch.from_pydict({"path": paths})])))
    assert sorted(p for b in module._records(iter(ranges)) for p in b.column("page_id").to_pylist()) == list(range(6))
