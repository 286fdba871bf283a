"""Members of zip archives as rows (S3): a partitioned Python data source.

Spark has no codec for zip. The directory at the end of an archive is read once
on the driver; every member is a partition of its own, and a task inflates its
member as a stream: it holds one chunk and the lines of one batch, never the
member or the archive. A lost task reads its member again.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = 10_000  # in a batch
NAME = "marketlens_zip"


class _Stream(io.RawIOBase):
    """A pyarrow file as the file object that ``zipfile`` expects: a seek
    before the start, by which it tells small archives, is an OSError."""

    def __init__(self, uri: str):
        from pyarrow import fs
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("seek before the start")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(uri: str) -> io.BufferedReader:
    """A local file, or one of any file system that pyarrow knows by its address."""
    return io.BufferedReader(_Stream(uri), 1 << 16)


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str], suffix: str, encoding: str):
        self.paths, self.suffix, self.encoding = paths, suffix, encoding

    def partitions(self) -> list[Member]:
        out = []
        for path in self.paths:
            with _open(path) as stream, zipfile.ZipFile(stream) as archive:
                out += [Member(path, m.filename) for m in archive.infolist() if not m.is_dir() and m.filename.endswith(self.suffix)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member at all
            return
        # a line ends at \n or \r\n; other line breaks are text
        with _open(partition.path) as stream, zipfile.ZipFile(stream) as archive, archive.open(partition.name) as raw:
            lines, number = [], 0
            for line in io.TextIOWrapper(raw, self.encoding, newline="\n"):
                lines.append(line.removesuffix("\n").removesuffix("\r"))
                if len(lines) == LINES:
                    yield _batch(partition.name, number, lines)
                    number, lines = number + len(lines), []
            if lines:
                yield _batch(partition.name, number, lines)


def _batch(member: str, number: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([member] * n, pa.string()), pa.array(range(number, number + n), pa.int64()), pa.array(lines, pa.string())],
        names=["member", "line_number", "value"])


class ZipSource(DataSource):
    """Options: ``path`` (several separated by newlines), ``suffix`` of the
    members read, ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "member string, line_number long, value string"

    def reader(self, schema) -> ZipReader:
        return ZipReader([p for p in self.options["path"].split("\n") if p], self.options.get("suffix", ""),
                         self.options.get("encoding", "utf-8"))


def read_zip_lines(spark: SparkSession, paths: str | list[str], suffix: str = "", encoding: str = "utf-8") -> DataFrame:
    """(member, line_number from 0, value): the lines of all members."""
    spark.dataSource.register(ZipSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(NAME).options(suffix=suffix, encoding=encoding).load("\n".join(paths))


def read_zip_csv(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",",
                 timestamp_format: str | None = None, suffix: str = ".csv") -> DataFrame:
    """Header CSV members of zip archives with a declared schema, plus the
    column ``member``. The first line of every member is its header. Malformed
    values become NULL. A record is one line: quoted line breaks are not read."""
    lines = read_zip_lines(spark, paths, suffix).where((F.col("line_number") > 0) & (F.col("value") != ""))
    options = {"sep": sep, "mode": "PERMISSIVE"} | ({"timestampFormat": timestamp_format} if timestamp_format else {})
    return lines.select("member", F.from_csv("value", schema, options).alias("r")).select("member", "r.*")
