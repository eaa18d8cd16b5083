from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from vellumine.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_round_trip_and_revisits(spark):
    rows = [(3, "u3", "same"), (1, "u\r\n1", "same"), (2, None, "é" * 10), (9, "u9", None), (8, "u8", ""), (None, "u", "same"), (2, None, "é" * 10)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", record_type string, first int").repartition(3)
    found = rows_of(warc.round_trip(frame))
    assert found == sorted(
        [
            (1, 4, digest("same"), "response", None),
            (3, 4, digest("same"), "revisit", 1),
            (None, 4, digest("same"), "revisit", 1),
            (2, 20, digest("é" * 10), "response", None),
            (2, 20, digest("é" * 10), "response", None),
            (8, 0, digest(""), "response", None),
            (9, 0, digest(""), "revisit", 8),
        ],
        key=str,
    )


def test_smaller_payloads_are_all_responses(spark):
    frame = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyy"), (4, "d", "yyy")], SCHEMA)
    assert [(r[0], r[3]) for r in rows_of(warc.round_trip(frame, dedupe_bytes=3))] == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_oversized_payloads_come_in_chunks(spark, monkeypatch, tmp_path):
    text = "0123456789" * 400_000
    folder = f"file://{tmp_path}/archives"
    written = warc.write_warc(spark.createDataFrame([(1, "u", text)], SCHEMA), folder)
    rows = warc.read_warc(written, folder).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(-(-len(text) // warc.CHUNK)))
    assert max(len(r.data) for r in rows) == warc.CHUNK
    assert b"".join(bytes(r.data) for r in rows).decode() == text
    running, done = hashlib.sha1(), 0
    for r in rows:
        running.update(bytes(r.data))
        done += len(r.data)
        assert (r.payload_bytes, r.payload_digest) == (done, base64.b32encode(running.digest()).decode())
    assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]


def test_archives_are_plain_warc(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    written = warc.write_warc(spark.createDataFrame([(5, "http://x/y z", "<p>\r\n\r\nWARC/1.1\r\n</p>")], SCHEMA), folder).where("records > 0").first()
    raw = gzip.decompress(open(written.path, "rb").read())
    head, _, block = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Target-URI: http://x/y%20z")
    length = int([line for line in head.split(b"\r\n") if line.startswith(b"Content-Length")][0].split(b": ")[1])
    assert block[length:] == b"\r\n\r\n" and block[:length].endswith(b"</p>")


def test_truncated_archives_are_errors(tmp_path):
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 100\r\n\r\nshort"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(body))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_chunks(str(tmp_path / "a.warc.gz"), fs.LocalFileSystem()))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"nonsense\r\n\r\n"))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.read_chunks(str(tmp_path / "b.warc.gz"), fs.LocalFileSystem()))


def test_reader_splits_at_any_piece_size():
    body = b"".join(b"".join(warc._record(i, "u", memory(p), digest(p.decode()), None, True)) for i, p in enumerate([b"", b"a" * 1000, b"\r\n\r\n" * 5]))
    for size in (1, 7, 4096):
        stream = io.BytesIO(body)
        lines = warc._Lines(iter(lambda: stream.read(size), b""))
        seen = []
        while (header := lines.header()) is not None:
            seen.append(len(lines.take(int(header["content-length"]))))
        assert seen == [len(warc._HTTP) + n for n in (0, 1000, 20)]


def memory(raw):
    import pyarrow as pa

    return pa.py_buffer(raw)


def test_well_packed_archives_come_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1 << 12)
    parts = [b"a" * 3_000_000, b"", bytes(range(256)) * 300, b"b"]
    packed = b"".join(gzip.compress(p) for p in parts)
    pieces = list(warc._reads(io.BytesIO(packed)))
    assert b"".join(pieces) == b"".join(parts) and max(map(len, pieces)) <= 1 << 12
    assert b"".join(warc._reads(Slow(packed))) == b"".join(parts)


class Slow(io.BytesIO):
    """Gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(7)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_copies_are_looked_up_by_file(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"page {i % 7}" if i % 3 else f"own {i}") for i in range(200)] + [(None, "n", "page 1"), (5, "again", "page 5"), (300, "z", None), (301, "z", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    pages.repartition(5).write.parquet(str(tmp_path / "pages"))
    pages.where("page_id is null").write.mode("append").parquet(str(tmp_path / "pages"))
    read = spark.read.parquet(str(tmp_path / "pages"))
    want = sorted((tuple(r) for r in warc.round_trip(read).collect()), key=str)
    assert sum(r[3] == "revisit" for r in want) > 100
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 0)
    spied = []
    real = warc._write
    monkeypatch.setattr(warc, "_write", lambda folder, lookup: spied.append(lookup) or real(folder, lookup))
    assert sorted((tuple(r) for r in warc.round_trip(read).collect()), key=str) == want
    assert sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(read.collect(), SCHEMA)).collect()), key=str) == want
    assert [x is None for x in spied] == [False, True]


def test_against_oracle(same):
    same(queries.op8_warc, queries.ORACLE_SQL["op8_warc"])


def test_a_task_that_runs_twice_leaves_another_file(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Attempt:
        number = 0

        @classmethod
        def get(cls):
            return cls

        @staticmethod
        def partitionId():
            return 3

        @classmethod
        def taskAttemptId(cls):
            return cls.number

    monkeypatch.setattr(pyspark, "TaskContext", Attempt)
    folder = f"file://{tmp_path}/archives"
    (tmp_path / "archives").mkdir()
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "payload": [b"p"], "digest": [hashlib.sha1(b"p").digest()], "first": pa.nulls(1, pa.int64()), "response": [True]})
    named = []
    for Attempt.number in (10, 11):
        named += [row["path"] for out in warc._write(folder)([batch]) for row in out.to_pylist()]
    assert len(set(named)) == 2
    archives = spark.createDataFrame([(named[1], 1)], "path string, records long")
    assert [r.record_id for r in warc.read_warc(archives, folder).collect()] == ["<urn:page:1>"]


def test_each_archive_has_a_task(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", "x" * i) for i in range(40)], SCHEMA).repartition(7)
    written = warc.write_warc(frame, f"file://{tmp_path}/archives")
    read = warc.read_warc(written, f"file://{tmp_path}/archives")
    assert read.rdd.getNumPartitions() == written.where("records > 0").count() == 7


def test_many_copies_are_joined_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 1)
    rows = [(i, "u", f"text {i % 3}") for i in range(30)]
    found = rows_of(warc.round_trip(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((r[0], r[3], r[4]) for r in found) == [(i, "response", None) if i < 3 else (i, "revisit", i % 3) for i in range(30)]
