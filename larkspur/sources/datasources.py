"""Data sources in Python: SQLite tables by row-id ranges (S10), files that change as a stream (R1), ordered exports with commit and abort.

Each names files on a path that the driver and all executors share. What is read or written passes tasks only; the driver lists, plans and commits.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from larkspur.session import ship


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class RowIds(InputPartition):
    """Rows with first <= row id <= last."""

    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.column = _local(options["path"]), options["table"], options["column"]
        self.rows = int(options.get("rowsperpartition", "10000"))

    def _open(self) -> contextlib.closing[sqlite3.Connection]:
        return contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True))

    def partitions(self) -> list[RowIds]:
        """As many ranges of row ids, of equal width, as it takes for `rowsPerPartition` rows each on average."""
        with self._open() as db:
            n, least, most = db.execute(f"select count(*), min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if not n:
            return [RowIds(0, -1)]
        parts = -(-n // self.rows)
        width = -(-(most - least + 1) // parts)
        return [RowIds(at, min(at + width - 1, most)) for at in range(least, most + 1, width)]

    def read(self, partition: RowIds) -> Iterator[tuple[int, str]]:
        """Rows whose column holds a string, a page at a time."""
        with self._open() as db:
            rows = db.execute(f"select rowid, {_quoted(self.column)} from {_quoted(self.table)} where rowid between ? and ? and typeof({_quoted(self.column)}) = 'text'", (partition.first, partition.last))
            while some := rows.fetchmany(1000):
                yield from some


class SqliteTable(DataSource):
    """(id, text): the row id and a text column of a table with row ids. Options: path, table, column, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "id long, text string"

    def reader(self, schema: object) -> SqliteReader:
        return SqliteReader(self.options)


@dataclass
class Files(InputPartition):
    paths: list[str]


class ChangedFilesReader(DataSourceStreamReader):
    """Offsets name a listing: the files' paths, times of change and sizes as they were. Listings lie in the folder `listings` under their own hash, so the same files have the same offset."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.listings = _local(options["path"]), options.get("pattern", "*"), Path(_local(options["listings"]))
        self.least, self.bytes = int(options.get("leastbytes", "0")), int(options.get("bytesperpartition", str(64 << 20)))

    def _stored(self, offset: dict) -> dict[str, list[int]]:
        name = offset.get("listing")
        return json.loads((self.listings / f"{name}.json").read_text()) if name else {}

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if fnmatch(name, self.pattern):
                    path = os.path.join(folder, name)
                    with contextlib.suppress(FileNotFoundError):
                        told = os.stat(path)
                        if told.st_size >= self.least:
                            found[path] = [told.st_mtime_ns, told.st_size]
        text = json.dumps(found, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        self.listings.mkdir(parents=True, exist_ok=True)
        if not (self.listings / f"{name}.json").exists():
            part = self.listings / f".{name}-{uuid.uuid4().hex}"
            part.write_text(text)
            part.replace(self.listings / f"{name}.json")
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        """The files of end that start lacks or has with another time or size, in lists of about `bytesPerPartition`."""
        old, new = self._stored(start), self._stored(end)
        out, size = [], 0
        for path in sorted(p for p, told in new.items() if old.get(p) != told):
            if not out or size + new[path][1] > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += new[path][1]
        return out

    def read(self, partition: Files) -> Iterator[tuple[str, int, int, str, str]]:
        for path in partition.paths:
            try:
                told, content = os.stat(path), Path(path).read_bytes()
            except FileNotFoundError:  # gone since it was listed
                continue
            yield path, told.st_mtime_ns, len(content), content.decode("utf-8", "replace"), hashlib.sha256(content).hexdigest()

    def commit(self, end: dict) -> None:
        """Listings that no later batch starts from are deleted; the ones that a restart may need, this and what came after it, stay."""
        keep = self.listings / f"{end.get('listing')}.json"
        if keep.exists():
            for old in self.listings.glob("*.json"):
                if old != keep and old.stat().st_mtime_ns < keep.stat().st_mtime_ns - 3_600_000_000_000:
                    old.unlink(missing_ok=True)


class ChangedFiles(DataSource):
    """A stream of (path, modified, size, value, content_hash): each file when it is new and again whenever its time or size has changed.

    Options: path, listings (a folder of this stream's own, kept as long as its checkpoint), pattern, leastBytes, bytesPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "path string, modified long, size long, value string, content_hash string"

    def streamReader(self, schema: object) -> ChangedFilesReader:
        return ChangedFilesReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    rows: int


class OrderedExportWriter(DataSourceWriter):
    """Tasks write to a folder of the write's own; commit moves their files into place, abort removes them. Files and folders are their owner's only."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.packed, self.overwrite = Path(_local(options["path"])), options.get("compressed", "false") == "true", overwrite
        self.staging = self.path.parent / f"_{self.path.name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        self.staging.mkdir(mode=0o700, parents=True, exist_ok=True)
        # each attempt has a file of its own; only those of the attempts that Spark took are moved
        file, n = self.staging / f"{task.partitionId():05d}-{task.taskAttemptId()}", 0
        with os.fdopen(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.packed else contextlib.nullcontext(raw) as out:
            for row in iterator:
                out.write(row[0].encode() + b"\n")
                n += 1
        return Written(task.partitionId(), str(file), n)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.part)
        if self.path.exists() and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(str(self.path))
        self.staging.mkdir(mode=0o700, parents=True, exist_ok=True)
        for m in done:
            os.replace(m.file, self.staging / f"part-{m.part:05d}.json{'.gz' if self.packed else ''}")
        for left in self.staging.glob("[0-9]*"):  # of attempts that failed
            left.unlink()
        with os.fdopen(os.open(self.staging / "_manifest.json", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as out:
            json.dump({"rows": sum(m.rows for m in done), "parts": [m.rows for m in done]}, out)
        before = self.staging.with_name(f"{self.staging.name}-before")
        if self.path.exists():
            self.path.rename(before)
        self.staging.rename(self.path)
        shutil.rmtree(before, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class OrderedExport(DataSource):
    """Writes lines (value) as part-00000.json and so on, in the order of the partitions, with _manifest.json of the counts. Options: path, compressed."""

    @classmethod
    def name(cls) -> str:
        return "ordered_export"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: object, overwrite: bool) -> OrderedExportWriter:
        return OrderedExportWriter(self.options, overwrite)


def register_sources(spark: SparkSession) -> None:
    """Make the data sources known to the session."""
    ship(spark)
    for source in (SqliteTable, ChangedFiles, OrderedExport):
        spark.dataSource.register(source)
