"""A giant JSON file that is one object ``{id: record}``, as a Spark data source.

The file is decoded incrementally, so neither the file nor its parse tree has to fit in
memory; a record is bounded. Paths may be local or of any file system known to pyarrow
(``hdfs://``, ``s3://``, ``gs://``). One file is one partition (an object cannot be split
safely); a folder of files is read in parallel. Repeated ids are yielded each time. A truncated
file, a trailing comma, content after the object, a value that is not an object and a
record over the limit are errors.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK_CHARS, RECORD_CHARS = 1 << 20, 4 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path belongs to, local for plain paths, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Window:
    """A sliding window over a text file: what has been parsed falls away, what is missing is read."""

    def __init__(self, stream, chunk: int, limit: int) -> None:
        self.stream, self.chunk, self.limit, self.text, self.done = stream, chunk, limit, "", False

    def more(self) -> bool:
        part = "" if self.done else self.stream.read(self.chunk)
        self.done = self.done or not part
        self.text += part
        return bool(part)

    def peek(self) -> str:
        """The next character that is no blank; empty at the end of the file."""
        while True:
            self.text = self.text.lstrip(" \t\r\n")
            if self.text:
                return self.text[0]
            if not self.more():
                return ""

    def take(self, expected: str) -> None:
        found = self.peek()
        if found != expected:
            raise ValueError(f"expected {expected!r}, found {found!r}" if found else f"file ends where {expected!r} should be")
        self.text = self.text[1:]

    def value(self, decoder: json.JSONDecoder):
        """The next JSON value; grows the window until it is complete."""
        self.peek()
        while True:
            try:
                parsed, end = decoder.raw_decode(self.text)
            except json.JSONDecodeError:
                parsed, end = None, -1
            # a number or literal that touches the end of the window may go on
            if 0 <= end < len(self.text) or (end == len(self.text) and self.done):
                self.text = self.text[end:]
                return parsed
            if len(self.text) > self.limit:
                raise ValueError(f"a record is longer than {self.limit} characters or is broken")
            if not self.more() and end < 0:
                raise ValueError("the file is truncated or not JSON")


def iter_object(path: str, chunk: int = CHUNK_CHARS, limit: int = RECORD_CHARS) -> Iterator[tuple[str, dict]]:
    """``(id, record)`` in file order."""
    decoder = json.JSONDecoder()
    system, inner = file_system(path)
    with system.open_input_stream(inner) as raw:
        window = _Window(codecs.getreader("utf-8-sig")(raw), chunk, limit)
        window.take("{")
        first = True
        while window.peek() != "}":
            if not first:
                window.take(",")
            if window.peek() != '"':
                raise ValueError("a key must be a string")
            key = window.value(decoder)
            window.take(":")
            record = window.value(decoder)
            if not isinstance(record, dict):
                raise ValueError(f"record {key!r} is not an object")
            yield key, record
            first = False
        window.take("}")
        if window.peek():
            raise ValueError("content after the object")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.chunk, self.limit = int(options.get("chunk", CHUNK_CHARS)), int(options.get("limit", RECORD_CHARS))

    def partitions(self) -> list[InputPartition]:
        system, inner = file_system(self.path)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return [InputPartition(self.path)]
        scheme = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.path.endswith(".json"))
        return [InputPartition(scheme + name) for name in names]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for key, record in iter_object(partition.value, self.chunk, self.limit):
            yield key, json.dumps(record, ensure_ascii=False)


class JsonObjectSource(DataSource):
    """``spark.read.format("json_object").load(path)`` gives ``id string, record string``."""

    @classmethod
    def name(cls) -> str:
        return "json_object"

    def schema(self) -> str:
        return "id string, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonObjectSource)
