"""WARC archives of pages, and reading them back as a chunked record table.

Writing: every partition becomes one ``.warc.gz`` file in the shared folder, a
gzip member per record.  Records with a payload that an earlier record has
become revisits, which carry its digest and length but not the payload.

Reading streams: a record's block is read in pieces of ``CHUNK`` bytes, and each
piece is a row (record id, chunk number, bytes) with the SHA-1 of the payload so
far, so that neither side ever holds more of a record than one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.plans.durable import discard, materialise, shared_dir
from vellumine.plans.skew import meet

#: Bytes of a payload that a chunk row holds.
CHUNK = 1 << 20
#: Copies that may be broadcast (about 50 bytes each); beyond, tasks look them up by the file that they read.
BROADCAST_REPEATS = 500_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _gzip(parts: Iterator[bytes]) -> Iterator[bytes]:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    for part in parts:
        yield press.compress(part)
    yield press.flush()


def _record(page_id, url, payload: pa.Buffer, digest: str, first, response: bool) -> Iterator[bytes]:
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", _record_id(page_id))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if not response:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(first)), ("X-Payload-Length", payload.size)]
    yield _headers([*fields, ("Content-Length", len(_HTTP) + payload.size * response)]) + _HTTP
    for at in range(0, payload.size * response, CHUNK):
        yield payload[at : at + CHUNK].to_pybytes()
    yield b"\r\n\r\n"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _looked_up(batches: Iterator[pa.RecordBatch], lookup: str) -> Iterator[pa.RecordBatch]:
    """Rows (..., file, row) with ``first`` and ``response``, from what the lookup has for each file; one file's at a time."""
    store, root = _store(lookup)
    known, rows, firsts = None, np.zeros(0, dtype=np.int64), pa.nulls(0, pa.int64())
    for batch in batches:
        files = batch.column("file").to_pylist()
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and files[end] == files[at]:
                end += 1
            if files[at] != known:
                known = files[at]
                place = f"{root}/at={hashlib.sha1(known.encode()).hexdigest()}"
                there = store.get_file_info(place).type == fs.FileType.Directory
                table = dataset.dataset(place, filesystem=store, format="parquet").to_table(columns=["row", "first"]).sort_by("row") if there else pa.table({"row": pa.nulls(0, pa.int64()), "first": pa.nulls(0, pa.int64())})
                rows, firsts = table["row"].to_numpy(), table["first"].combine_chunks()
            part = batch.slice(at, end - at)
            own = part.column("row").to_numpy()
            found = np.searchsorted(rows, own)
            hit = np.zeros(len(own), dtype=bool)
            inside = found < len(rows)
            hit[inside] = rows[found[inside]] == own[inside]
            first = firsts.take(pa.array(np.where(hit, found, 0), mask=~hit))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "payload", "digest")), first, first.is_null()], names=["page_id", "url", "payload", "digest", "first", "response"])
            at = end


def _write(folder: str, lookup: str | None = None):
    def run(batches):
        from pyspark import TaskContext

        if lookup is not None:
            batches = _looked_up(batches, lookup)

        store, root = _store(folder)
        task = TaskContext.get()
        # attempts write files of their own, and only those in the returned table count
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records = 0
        with store.open_output_stream(name, compression=None) as out:
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "response")]
                for page_id, url, payload, digest, first, response in zip(*columns):
                    for part in _gzip(_record(page_id.as_py(), url.as_py(), payload.as_buffer(), base64.b32encode(digest.as_py()).decode(), first.as_py(), response.as_py())):
                        out.write(part)
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["path", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, dedupe_bytes: int = 0) -> DataFrame:
    """Write one archive per partition into folder; returns ``(path, records)``, already written.

    Of records with equal payloads of ``dedupe_bytes`` or more, those with the
    smallest page_id are responses and the others revisits of it.  A null html
    is the empty payload.  A null page_id counts as the largest; rows that
    repeat the smallest page_id and its payload are responses each.

    ``folder`` lies in a store that pyarrow can open.  A task that is run again
    writes another file; those that the table does not name are left-overs.

    Payloads stay where they are read: few copies are broadcast, and many are
    written by the file and row of their pages, where the tasks that read those
    files look them up.  Only pages that are no rows of Parquet files are joined.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    spent: list[str] = []
    pages, located = _located(pages)
    place = ("file", "row") if located else ()
    digests = materialise(pages.select("page_id", *place, F.octet_length(payload).alias("bytes"), F.unhex(F.sha1(payload)).alias("sha1")), spent)
    counted = digests.where(F.col("bytes") >= dedupe_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(counted, spent)
    # one payload may stand on any share of the pages
    copies = meet(digests, firsts, ["sha1", "bytes"], "n", kept=spent).where("page_id is null or page_id != first")
    repeats = materialise(copies.select("page_id", "sha1", "first", *place), spent)
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"), *place)
    few = repeats.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS
    lookup = None
    if located and not few:
        lookup = shared_dir(spark)
        spent.append(lookup)
        by_file = repeats.select(F.sha1("file").alias("at"), "row", "first")
        by_file.repartition("at").sortWithinPartitions("at", "row").write.parquet(lookup, partitionBy=["at"])
    else:
        own = repeats.select(F.col("page_id").alias("own"), F.col("sha1").alias("same"), "first").distinct()
        met = rows.join(F.broadcast(own) if few else own, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left")
        rows = met.select("page_id", "url", "payload", "digest", "first", F.col("first").isNull().alias("response"))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    written = materialise(rows.mapInArrow(_write(folder, lookup), "path string, records long"))
    discard(spark, spent)
    return written


def _located(pages: DataFrame) -> tuple[DataFrame, bool]:
    """``(page_id, url, html, file, row)`` of pages that are rows of Parquet files, and whether they are."""
    try:
        return pages.select("page_id", "url", "html", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")), True
    except AnalysisException:
        return pages.select("page_id", "url", "html"), False


def _reads(stream) -> Iterator[bytes]:
    """The decompressed bytes of a stream of gzip members, in pieces of CHUNK at most however well they were packed."""
    unpack = zlib.decompressobj(31)
    while raw := stream.read(1 << 18):
        while raw:
            yield unpack.decompress(raw, CHUNK)
            if unpack.eof:
                raw, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                raw = unpack.unconsumed_tail


class _Lines:
    """Lines and counted bytes of a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[: at + 1], self.held[at + 1 :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, fewer only at the end."""
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out

    def header(self) -> dict[str, str] | None:
        while (line := self.line()) is not None and not line.strip():
            pass
        if line is None:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        out = {}
        while (line := self.line()) is not None and line.strip():
            key, _, value = line.decode().partition(":")
            out[key.strip().lower()] = value.strip()
        return out


def read_chunks(path: str, store: fs.FileSystem, chunk: int = CHUNK) -> Iterator[tuple]:
    """(header, chunk number, bytes, payload bytes so far, SHA-1 so far, last) of every record."""
    with store.open_input_stream(path, compression=None) as raw:
        lines = _Lines(_reads(raw))
        while (header := lines.header()) is not None:
            left = int(header["content-length"])
            if header.get("content-type", "").startswith("application/http"):
                while left > 0 and (line := lines.line()) is not None:
                    left -= len(line)
                    if not line.strip():
                        break
            digest, done, number = hashlib.sha1(), 0, 0
            while True:
                data = lines.take(min(left, chunk))
                if len(data) < min(left, chunk):
                    raise ValueError(f"{path} ends inside a record")
                left -= len(data)
                done += len(data)
                digest.update(data)
                yield header, number, data, done, base64.b32encode(digest.digest()).decode(), left == 0
                number += 1
                if not left:
                    break


_CHUNKS = "record_id string, chunk int, data binary, payload_bytes long, payload_digest string, last boolean, record_type string, refers_to string, url string"


def _read(folder: str, keep_data: bool):
    def run(batches):
        store, _ = _store(folder)
        rows, held = [], 0

        def batch():
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _CHUNKS.split(", ")])

        for paths in batches:
            for path in paths.column("path").to_pylist():
                for header, number, data, done, digest, last in read_chunks(path, store):
                    if header["warc-type"] == "revisit":
                        done, digest = int(header["x-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((header["warc-record-id"], number, data if keep_data else None, done, digest, last, header["warc-type"], header.get("warc-refers-to"), header.get("warc-target-uri")))
                    held += len(data)
                    if held > 4 * CHUNK or len(rows) >= 5000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run


def read_warc(archives: DataFrame, folder: str, keep_data: bool = True) -> DataFrame:
    """Chunk rows of the archives: record id, chunk number, bytes, and digest and length so far.

    Each archive is read by a task of its own.  The row with ``last`` has those of the full payload; a revisit's are the
    ones that it states for the record it refers to.
    """
    files = archives.where("records > 0").select("path")
    # a stated number of partitions is one that adaptive execution leaves alone
    return files.repartition(max(1, files.count())).mapInArrow(_read(folder, keep_data), _CHUNKS)


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", dedupe_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back, a row per record.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.  Nulls
    and repeats are as ``write_warc`` says; extra columns are ignored; an empty
    table gives an empty one.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    folder = shared_dir(pages.sparkSession)
    chunks = read_warc(write_warc(rows, folder, dedupe_bytes), folder, keep_data=False)

    def page(record):
        return F.regexp_extract(record, r"urn:page:(-?\d+)", 1).try_cast("long")

    return chunks.where("last").select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
