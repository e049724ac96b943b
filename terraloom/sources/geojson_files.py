"""GeoJSON files as a data source: spark.read.format("geojson") and df.write.format("geojson"), after register(spark).

Reading gives a row for each feature of each file of a folder (path, feature_no, geojson, error), a task for each file. A file that
can't be read or parsed, or holds neither a feature nor a collection, gives one row with an error. A file is read twice, piece by piece:
to see that it is whole, then for its features. A task holds a piece and one value (a feature, a member that is no list), not the file.

Writing takes a column geojson (features as text; nulls are left out) and writes collections, one for each task and each value of the
column that the option "by" names, in a folder for each value; a task begins another file after FILE_BYTES. Files are written aside and moved when all tasks have ended; a failed
job leaves nothing. Paths are local or any that pyarrow's file systems open; the folder must be one that all executors see.
"""

from __future__ import annotations

import codecs
import contextlib
import json
import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENDING = ".geojson"
ASIDE = "_writing"
#: Bytes of a file that are read at once, and characters of rows that leave a reading task at once.
PIECE = 4 << 20
#: Bytes after which a writing task begins another file.
FILE_BYTES = 64 << 20
#: What comes after a piece can still change a value or an error in its last few characters: a number, a literal, an escape.
AHEAD = 16

_ROW = pa.schema([("path", pa.string()), ("feature_no", pa.int32()), ("geojson", pa.string()), ("error", pa.string())])
_decoded = json.JSONDecoder().raw_decode
_blanks = re.compile(r"[ \t\n\r]*").match


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(where: fs.FileSystem, base: str) -> list[str]:
    chosen = fs.FileSelector(base, recursive=True, allow_not_found=True)
    return sorted(f.path for f in where.get_file_info(chosen) if f.type == fs.FileType.File and f.path.endswith(ENDING) and f"/{ASIDE}/" not in f.path)


class _Text:
    """JSON text of a file, of which no more is held than the next value needs."""

    def __init__(self, f: pa.NativeFile) -> None:
        self._file, self._text, self._at, self._ended = f, "", 0, False
        self._utf8 = codecs.getincrementaldecoder("utf-8")()

    def _more(self) -> None:
        got = self._file.read(max(PIECE, len(self._text) - self._at))
        self._ended = not got
        self._text, self._at = self._text[self._at :] + self._utf8.decode(got, final=not got), 0

    def peek(self) -> str:
        """The next character that is no blank; empty at the end."""
        while True:
            self._at = _blanks(self._text, self._at).end()
            if self._at < len(self._text) or self._ended:
                return self._text[self._at : self._at + 1]
            self._more()

    def take(self, chars: str) -> str:
        found = self.peek()
        if not found or found not in chars:
            raise ValueError(f"one of {chars} is missing")
        self._at += 1
        return found

    def value(self) -> object:
        self.peek()
        while True:
            try:
                found, end = _decoded(self._text, self._at)
                if self._ended or end + AHEAD <= len(self._text):
                    self._at = end
                    return found
            except json.JSONDecodeError as e:
                if self._ended or e.pos + AHEAD <= len(self._text) and not e.msg.startswith("Unterminated string"):
                    raise
            except ValueError:  # an integer of too many digits, unless a fraction follows
                if self._ended:
                    raise
            self._more()

    def elements(self) -> Iterator[object]:
        """The elements of a list, one after another."""
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return

    def members(self) -> Iterator[tuple[str, object]]:
        """Key and value of an object's members; for a list an iterator of its elements, to be used up before the next member."""
        self.take("{")
        if self.peek() == "}":
            self.take("}")
            return
        while True:
            if self.peek() != '"':
                raise ValueError("a key is missing")
            key = self.value()
            self.take(":")
            yield key, self.elements() if self.peek() == "[" else self.value()
            if self.take(",}") == "}":
                return


def _outline(text: _Text) -> tuple[object, int | None, int | None]:
    """The type of a whole file, which of its members holds the features, and their count; of a key's repetitions the last counts, as in json."""
    kind = at = count = None
    if text.peek() == "{":
        for i, (key, value) in enumerate(text.members()):
            listed = isinstance(value, Iterator)
            n = sum(1 for _ in value) if listed else None
            if key == "type":
                kind = None if listed else value
            elif key == "features":
                at, count = i, n
    else:
        deque(text.elements() if text.peek() == "[" else [text.value()], 0)
    if text.peek():
        raise ValueError("more than one value")
    return kind, at, count


def _member(text: _Text, at: int) -> Iterator[object]:
    """The elements of the list in one of an object's members."""
    for i, (_, value) in enumerate(text.members()):
        if i == at:
            yield from value
            return
        if isinstance(value, Iterator):
            deque(value, 0)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by their text; Spark's own are bounded by the number of rows."""
    kept, size = [], 0
    for row in rows:
        kept.append(dict(zip(_ROW.names, row, strict=True)))
        size += len(row[0]) + len(row[2] or "")
        if size >= PIECE:
            yield pa.RecordBatch.from_pylist(kept, schema=_ROW)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=_ROW)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self._path = path

    def partitions(self) -> list[InputPartition]:
        where, base = _open(self._path)
        info = where.get_file_info(base)
        return [_File(p) for p in ([base] if info.type == fs.FileType.File else _files(where, base))]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # else an empty folder
            yield from _batches(self._rows(partition.value))

    def _rows(self, name: str) -> Iterator[tuple]:
        where, _ = _open(self._path)
        with contextlib.ExitStack() as stack:
            try:
                f = stack.enter_context(where.open_input_file(name))
                kind, at, count = _outline(_Text(f))
            except (OSError, ValueError):
                yield name, 0, None, "Invalid JSON"
                return
            if kind != "Feature" and (kind != "FeatureCollection" or count is None):
                yield name, 0, None, "Unsupported GeoJSON type"
            elif kind == "FeatureCollection" and count == 0:
                yield name, 0, None, "Empty FeatureCollection"
            else:
                f.seek(0)
                text = _Text(f)
                for i, feature in enumerate([text.value()] if kind == "Feature" else _member(text, at)):
                    yield name, i, json.dumps(feature), None


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and where it belongs


class _Writer(DataSourceWriter):
    def __init__(self, path: str, by: str | None, overwrite: bool) -> None:
        self._path, self._by, self._overwrite, self._job = path, by, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        where, base = _open(self._path)
        task, files = uuid.uuid4().hex, []
        with contextlib.ExitStack() as stack:
            key, out, size = object(), None, 0
            for row in rows:
                if row["geojson"] is None:
                    continue
                own = None if self._by is None else row[self._by]
                if out is None or own != key or size >= FILE_BYTES:  # rows come sorted by the key
                    if out is not None:
                        out.write(b"]}")
                        stack.close()
                    folder = "" if self._by is None else f"{quote(self._by)}={quote(str(own), safe='')}/"
                    name = f"part-{task}-{len(files)}{ENDING}"
                    aside = f"{base}/{ASIDE}/{self._job}"
                    where.create_dir(aside, recursive=True)
                    out, key, size = stack.enter_context(where.open_output_stream(f"{aside}/{name}")), own, 0
                    files.append((f"{aside}/{name}", f"{base}/{folder}{name}"))
                    out.write(b'{"type":"FeatureCollection","features":[')
                text = row["geojson"].encode("utf-8")
                out.write(b"," + text if size else text)
                size += len(text) + 1
            if out is not None:
                out.write(b"]}")
        return _Written(files)

    def _end(self, where: fs.FileSystem, base: str) -> None:
        with contextlib.suppress(OSError):
            where.delete_dir(f"{base}/{ASIDE}/{self._job}")
        if not [f for f in where.get_file_info(fs.FileSelector(f"{base}/{ASIDE}", allow_not_found=True))]:
            with contextlib.suppress(OSError):
                where.delete_dir(f"{base}/{ASIDE}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, base = _open(self._path)
        where.create_dir(base, recursive=True)
        old = _files(where, base) if self._overwrite else []
        for message in messages:
            for at, to in message.files if message else []:
                where.create_dir(to.rpartition("/")[0], recursive=True)
                where.move(at, to)
        for name in old:
            where.delete_file(name)
        self._end(where, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._end(*_open(self._path))


class GeoJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson"

    def schema(self) -> str:
        return "path string, feature_no int, geojson string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        by = self.options.get("by")
        if "geojson" not in schema.names or by is not None and by not in schema.names:
            raise ValueError(f"a column geojson is needed{f', and one named {by}' if by else ''}")
        return _Writer(self.options["path"], by, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoJsonSource)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("geojson").load(path)


def write_files(features: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    """Write features (geojson, and the column by) as collections; the rows of one value go to few files, large values to several."""
    register(features.sparkSession)
    if by is not None:
        features = features.hint("rebalance", by).sortWithinPartitions(by)
    writer = features.write.format("geojson").mode(mode)
    (writer if by is None else writer.option("by", by)).save(path)
