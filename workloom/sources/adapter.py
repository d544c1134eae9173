"""Posting sources and sinks as a Spark data source: one partition for each region, fetched where the task runs.

``spark.dataSource.register(Postings)``, then ``spark.read.format("postings").option("adapter", "module:Class").option("regions",
"a,b").load()``. An adapter yields raw postings of a region and tells whether its source is healthy.

As a stream (``spark.readStream``) the source's offset is, for each region, how many of its postings have been taken; an adapter whose source only
grows need do no more. A batch is what lies between two offsets, so one that is broken off is read again as it was.

As a sink (``df.write`` or ``writeStream`` with ``option("path", ...)``) every task writes a file of its own under a name of its own, and only a
commit makes them part of the table: it writes a list of the files, named by the batch, in one step. What tasks left that failed is in no list, and
is removed by the abort. A batch that is committed again, after a restart, finds its list and changes nothing. ``committed`` reads what the lists
name. The folder is opened by pyarrow's file systems: stores that these don't know are not for this sink.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "source string, external_id string, title string, company string, raw_text string, region string"


class SourceAdapter(ABC):
    def configure(self, options: dict[str, str]) -> None:
        """Takes what it needs of the options of the read, whose names are in small letters."""

    @abstractmethod
    def fetch(self, region: str) -> Iterator[tuple]:
        """Rows of SCHEMA without the region."""

    def health_check(self) -> bool:
        return True

    def latest(self, region: str) -> int:
        """How many postings the region has by now."""
        return sum(1 for _ in self.fetch(region))

    def between(self, region: str, start: int, end: int) -> Iterator[tuple]:
        """The postings of a region from the start-th to before the end-th, in the order in which they came."""
        return islice(self.fetch(region), start, end)


class FolderAdapter(SourceAdapter):
    """Postings from JSON files, one object a line, in a folder for each region: stands in for sources that need a network.

    The option ``folder``, or a subclass, names the folder, a subclass the ``source`` that its rows carry; fields that a line lacks are null. The folder
    is opened by pyarrow's file systems. As a stream: files are never changed, and new ones have names that come after all others.
    """

    folder = "."
    source = "folder"

    def configure(self, options: dict[str, str]) -> None:
        self.folder = options.get("folder", self.folder)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(_uri(self.folder.rstrip("/")))

    def health_check(self) -> bool:
        store, root = self._store()
        return store.get_file_info(root).type.name == "Directory"

    def fetch(self, region: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{region}", allow_not_found=True))
        for path in sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json")):
            with store.open_input_stream(path) as raw, io.TextIOWrapper(raw, encoding="utf-8") as lines:
                for line in filter(str.strip, lines):
                    row = json.loads(line)
                    yield (self.source, *(row.get(c) for c in ("external_id", "title", "company", "raw_text")))


class Region(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def _adapter(options: dict) -> SourceAdapter:
    module, _, name = options["adapter"].partition(":")
    found = getattr(import_module(module), name)()
    found.configure({k.lower(): v for k, v in options.items()})
    if not found.health_check():
        raise RuntimeError(f"the source {options['adapter']} is not healthy")
    return found


def _regions(options: dict) -> list[str]:
    return [r.strip() for r in options["regions"].split(",") if r.strip()]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Region]:
        return [Region(r) for r in _regions(self.options)]

    def read(self, partition: Region) -> Iterator[tuple]:
        for row in _adapter(self.options).fetch(partition.name):
            yield (*row, partition.name)


class Span(InputPartition):
    def __init__(self, region: str, start: int, end: int) -> None:
        self.region, self.start, self.end = region, start, end


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.most = int({k.lower(): v for k, v in options.items()}.get("maxperregion", 0))
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return dict.fromkeys(_regions(self.options), 0)

    def latestOffset(self) -> dict:
        source, before = _adapter(self.options), self.seen or self.initialOffset()
        found = {r: source.latest(r) for r in _regions(self.options)}
        if self.most:
            found = {r: min(n, before.get(r, 0) + self.most) for r, n in found.items()}
        return {r: max(n, before.get(r, 0)) for r, n in found.items()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.seen = end
        return [Span(r, start.get(r, 0), n) for r, n in sorted(end.items()) if n > start.get(r, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for row in _adapter(self.options).between(partition.region, partition.start, partition.end):
            yield (*row, partition.region)

    def commit(self, end: dict) -> None:
        self.seen = end


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Writer:
    """What the writers of batches and of streams share."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool = False) -> None:
        self.path, self.columns, self.overwrite = options["path"].rstrip("/"), columns, overwrite

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        store.create_dir(f"{root}/data", recursive=True)
        name, n = f"{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{root}/data/{name}") as out:
            for row in iterator:
                n += 1
                out.write((json.dumps(dict(zip(self.columns, row, strict=True)), ensure_ascii=False, default=str) + "\n").encode())
        return Written([name], n)

    def _commit(self, messages: list[Written | None], batch: str) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        store.create_dir(f"{root}/commits", recursive=True)
        done = f"{root}/commits/{batch}.json"
        files = [f for m in messages if m for f in m.files]
        if store.get_file_info(done).type != fs.FileType.NotFound:
            self._remove(messages)  # committed before the restart: the files of then count
            return
        aside = f"{root}/commits/.{batch}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as out:
            out.write(json.dumps({"files": files, "rows": sum(m.rows for m in messages if m), "overwrite": self.overwrite}).encode())
        store.move(aside, done)

    def _remove(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        for name in [f for m in messages if m for f in m.files]:
            with contextlib.suppress(OSError):
                store.delete_file(f"{root}/data/{name}")


class _BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, f"{time.time_ns():020d}-{uuid.uuid4().hex}")

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}" if not path.startswith("file:") else path.replace("file:", "file://", 1)


def committed(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The rows of the files that the lists name; an overwriting commit drops what came before it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(_uri(path.rstrip("/")))
    lists = sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)) if not f.base_name.startswith("."))
    files: list[str] = []
    for name in lists:
        with store.open_input_stream(name) as source:
            one = json.loads(source.read())
        files = one["files"] if one["overwrite"] else files + one["files"]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/data/{f}" for f in files])


class Postings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options), schema.names, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options), schema.names)
