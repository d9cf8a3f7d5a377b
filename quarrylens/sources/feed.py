"""Acquisition as a Spark data source: one partition for each source that is due.

A fetcher brings a source's documents on an executor.  ``feed`` makes a data source of the fetchers
of each source type; as a batch it reads what is newer than each source's high-water mark, as a
stream its offsets are those marks, source by source.

The sources to fetch stand in a Parquet table (option ``due``: id, type, endpoint, mark), which
executors need not see.  A source that can't be fetched gives one row with ``error`` and doesn't
hold up the others; what it brought before the error stays.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FETCHED = "source_id string, original_uri string, content_timestamp timestamp, mime_type string, raw_content binary, error string"
MIME_TYPES = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "json": "application/json"}


@dataclass(frozen=True)
class Document:
    uri: str
    time: dt.datetime | None
    mime_type: str
    content: bytes


class Fetcher(Protocol):
    """Brings a source's documents with ``after`` < time <= ``until``; bounds and times may be None
    (a document without a time always counts).  Sent to executors, so it can be pickled."""

    def newest(self, source: dict[str, Any]) -> dt.datetime | None:
        """The time of the newest document, without reading more than that takes."""

    def fetch(self, source: dict[str, Any], after: dt.datetime | None, until: dt.datetime | None) -> Iterator[Document]: ...


def _located(endpoint: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", endpoint))


def _files(endpoint: str) -> Iterator[tuple[pyarrow.fs.FileSystem, pyarrow.fs.FileInfo]]:
    """The files under a folder, or the file itself; those whose names begin with _ or . are hidden."""
    fs, path = _located(endpoint)
    at = fs.get_file_info(path)
    if at.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(endpoint)
    found = [at] if at.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    yield from ((fs, f) for f in sorted(found, key=lambda f: f.path) if f.is_file and posixpath.basename(f.path)[0] not in "._")


def _wanted(time: dt.datetime | None, after: dt.datetime | None, until: dt.datetime | None) -> bool:
    return time is None or ((after is None or time > after) and (until is None or time <= until))


class FolderFetcher:
    """Every file of a folder is a document, as old as the file."""

    def newest(self, source: dict[str, Any]) -> dt.datetime | None:
        return max((f.mtime for _, f in _files(source["endpoint"])), default=None)

    def fetch(self, source: dict[str, Any], after: dt.datetime | None, until: dt.datetime | None) -> Iterator[Document]:
        for fs, f in _files(source["endpoint"]):
            if _wanted(f.mtime, after, until):
                with fs.open_input_stream(f.path) as stream:
                    yield Document(f.path, f.mtime, MIME_TYPES.get(f.extension.lower(), "text/plain"), stream.read())


class PostFetcher:
    """Lines of JSON: url, time (ISO 8601) and body, each of which may be missing."""

    def _posts(self, source: dict[str, Any]) -> Iterator[tuple[str, dict, dt.datetime | None]]:
        for fs, f in _files(source["endpoint"]):
            with fs.open_input_stream(f.path) as raw:
                for n, line in enumerate(io.BufferedReader(raw, 1 << 20)):
                    if line.strip():
                        post = json.loads(line)
                        time = dt.datetime.fromisoformat(post["time"]) if post.get("time") else None
                        yield f"{f.path}#{n}", post, time.replace(tzinfo=dt.timezone.utc) if time and time.tzinfo is None else time

    def newest(self, source: dict[str, Any]) -> dt.datetime | None:
        return max((t for _, _, t in self._posts(source) if t), default=None)

    def fetch(self, source: dict[str, Any], after: dt.datetime | None, until: dt.datetime | None) -> Iterator[Document]:
        for where, post, time in self._posts(source):
            if _wanted(time, after, until):
                body = post.get("body")
                yield Document(post.get("url") or where, time, "text/plain" if body is not None else "application/json", (json.dumps(post) if body is None else body).encode())


@dataclass
class Due(InputPartition):
    """One source and the span of time to fetch."""

    source: dict[str, Any]
    after: dt.datetime | None
    until: dt.datetime | None


def _due(path: str) -> list[dict[str, Any]]:
    fs, root = _located(path)
    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet")]
    return sorted((row for f in files for row in pyarrow.parquet.read_table(f, filesystem=fs).to_pylist()), key=lambda r: r["id"])


def _utc(time: dt.datetime | None) -> dt.datetime | None:
    return None if time is None else time.replace(tzinfo=dt.timezone.utc) if time.tzinfo is None else time


class _Reading:
    """What a batch and a stream have in common."""

    def __init__(self, fetchers: dict[str, Fetcher], due: str):
        self.fetchers, self.due = fetchers, due

    def read(self, partition: Due | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        source = partition.source
        try:
            for d in self.fetchers[source["type"]].fetch(source, partition.after, partition.until):
                yield source["id"], d.uri, d.time, d.mime_type, d.content, None
        except Exception as e:  # one source's fault is no other's; it is reported in its row
            yield source["id"], None, None, None, None, f"{type(e).__name__}: {e}"


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Due]:
        return [Due(row, _utc(row.get("mark")), None) for row in _due(self.due)]


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets: for each source the time of the newest document read, as ISO text."""

    def initialOffset(self) -> dict:
        return {row["id"]: mark.isoformat() for row in _due(self.due) if (mark := _utc(row.get("mark")))}

    def latestOffset(self) -> dict:
        marks = self.initialOffset()
        for row in _due(self.due):
            try:
                newest = self.fetchers[row["type"]].newest(row)
            except Exception:  # read, when something else is new, tells what it is
                newest = None
            if newest is not None and (row["id"] not in marks or newest > dt.datetime.fromisoformat(marks[row["id"]])):
                marks[row["id"]] = newest.isoformat()
        return marks

    def partitions(self, start: dict, end: dict) -> list[Due]:
        time = lambda x: None if x is None else dt.datetime.fromisoformat(x)
        return [Due(row, time(start.get(row["id"])), time(end.get(row["id"]))) for row in _due(self.due) if end.get(row["id"]) != start.get(row["id"])]


def register(spark: SparkSession, fetchers: dict[str, Fetcher], name: str = "feed") -> str:
    """Registers a data source over ``fetchers`` (by source type); returns its format's name."""

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FETCHED

        def reader(self, schema) -> DataSourceReader:
            return _Batch(fetchers, self.options["due"])

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(fetchers, self.options["due"])

    spark.dataSource.register(Feed)
    return name
