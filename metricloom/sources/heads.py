"""A data source of file heads: name, size and the first bytes of every file below a folder.

Files are listed once, dealt to tasks as lists of paths, and opened in the tasks through the file system of their scheme, so what is read does not grow
with the size of a file, and a file of any size is seen.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that one task opens, and bytes of a batch.
TASK_FILES = 200
BATCH_BYTES = 4 << 20
FORMAT = "file_heads"
#: A limit for whole files: a binary cell cannot hold more.
WHOLE = 2**31 - 64
SCHEMA = "path string, size bigint, head binary"


class PathList(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob, self.limit = options["path"], options.get("glob", "*"), int(options["bytes"])

    def partitions(self) -> list[PathList]:
        system, root = opened(self.folder)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        listed = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        inside = lambda path: path[len(root) :].split("/")
        found = sorted(
            (f.path, f.size) for f in listed
            if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob) and not any(part.startswith(("_", ".")) for part in (inside(f.path) or [f.base_name]))
        )
        return [PathList(found[k : k + TASK_FILES]) for k in range(0, len(found), TASK_FILES)] or [PathList([])]

    def read(self, partition: PathList) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        rows: list[tuple[str, int, bytes]] = []
        held = 0
        for path, size in partition.paths:
            with system.open_input_stream(path) as stream:
                head = stream.read(min(size, self.limit)) if size else b""
            rows.append((path, size, head))
            held += len(head)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path inside it."""
    system, root = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
    return system, root.rstrip("/")


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["path", "size", "head"])


def file_heads(spark: SparkSession, folder: str, limit: int, *, glob: str = "*") -> DataFrame:
    """``path, size, head`` of the files below a folder; ``head`` has at most ``limit`` bytes. Names that begin with ``_`` or ``.`` are left out, as Spark does."""
    spark.dataSource.register(HeadSource)
    return spark.read.format(FORMAT).option("path", folder).option("glob", glob).option("bytes", limit).load()
