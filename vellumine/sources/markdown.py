"""Markdown tables as a Spark data source: files with a head each, written in parallel and read back.

    spark.dataSource.register(MarkdownTable)
    rows.write.format("markdown-table").mode("overwrite").save(path)
    spark.read.format("markdown-table").schema("a string, b string").load(path)

A task writes a hidden file of its own under a name that no other attempt has,
and the commit moves those that count to names that readers see; with
``overwrite`` the files of before go only after that.  What attempts that failed
leave behind stays hidden.  Cells are strings; bars and backslashes in them are
escaped and white space is folded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

_CELL = re.compile(r"(?:[^|\\]|\\.)*")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".md") and not f.base_name.startswith((".", "_")))


def line(cells: list[str | None]) -> str:
    """A row of a table."""
    return "| " + " | ".join(" ".join((c or "").split()).replace("\\", "\\\\").replace("|", "\\|") for c in cells) + " |"


def cells(row: str) -> list[str]:
    """What ``line`` was made from, but for white space."""
    body = row.strip()[1:]
    out, at = [], 0
    while at < len(body):
        m = _CELL.match(body, at)
        out.append(re.sub(r"\\(.)", r"\1", m[0]).strip())
        at = m.end() + 1
    return out


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        # what is there before the job starts goes when it has ended well
        self.before = _files(path) if overwrite else []

    def write(self, iterator: Iterator) -> _Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, rows = f"{root}/_part-{uuid.uuid4().hex}.md", 0
        with store.open_output_stream(name) as out:
            out.write((line(self.names) + "\n" + "| " + " | ".join("---" for _ in self.names) + " |\n").encode())
            for row in iterator:
                out.write((line(list(row)) + "\n").encode())
                rows += 1
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        done = [m for m in messages if m is not None]
        # a file for every task that had rows, and one with a head alone if none had
        kept = {m.file for m in done if m.rows} or {m.file for m in done[:1]}
        for m in done:
            if m.file in kept:
                store.move(m.file, m.file.replace("/_part-", "/part-"))
            else:
                store.delete_file(m.file)
        for file in self.before:
            store.delete_file(file)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.file)


class _Part(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in _files(self.path)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, _ = _store(self.path)
        file = getattr(partition, "file", None)
        if file is None:
            return
        with store.open_input_stream(file) as raw:
            text = raw.read().decode()
        head: list[str] | None = None
        for row in text.split("\n"):
            if not row.lstrip().startswith("|"):
                head = None
            elif head is None:
                head = cells(row)
            elif not re.fullmatch(r"[|\s:-]+", row) or "-" not in row:
                by_name = dict(zip(head, cells(row)))
                yield tuple(by_name.get(n) for n in self.names)


class MarkdownTable(DataSource):
    """Tables of Markdown files under a path; the columns of a read are found by the names in each table's head."""

    @classmethod
    def name(cls) -> str:
        return "markdown-table"

    def schema(self) -> StructType:
        for file in _files(self.options["path"]):
            store, _ = _store(self.options["path"])
            with store.open_input_stream(file) as raw:
                first = next((x for x in raw.read().decode().split("\n") if x.lstrip().startswith("|")), None)
            if first:
                return StructType([StructField(n, StringType()) for n in cells(first)])
        raise ValueError("no table under the path; give a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)
