"""Arrow files (Feather) as a Spark data source: schema from the footer, a task per record batches.

The footer of an Arrow file lists its record batches, so a file is split without reading it and a
task reads only its own batches, one at a time. Files are opened through ``pyarrow.fs``: mounted
folders by path, object stores and HDFS by their addresses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from plumbline.storage import local_table

#: Bytes of a file that one task takes, as long as its batches are smaller.
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def data_files(path: str, empty: bool = False) -> list[tuple[str, int]]:
    """Files at or below a path with their sizes, without hidden ones, in order of their names;
    files without content only if ``empty``."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in system.get_file_info(
        fs.FileSelector(inner, recursive=True))
        if f.type == fs.FileType.File and (f.size or empty) and not f.base_name.startswith(("_", ".")))


def _reader(path: str) -> pa.ipc.RecordBatchFileReader:
    system, inner = opened(path)
    return pa.ipc.open_file(system.open_input_file(inner))


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").load(path)`` after ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        found = data_files(self.options["path"])
        if not found:
            raise ValueError("no Arrow file at " + self.options["path"])
        return from_arrow_schema(_reader(found[0][0]).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowFilesReader(
            self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))


class Batches(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        super().__init__((path, first, end))
        self.path, self.first, self.end = path, first, end


class ArrowFilesReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int):
        self.path, self.fields, self.split_bytes = path, schema, split_bytes

    def partitions(self) -> list[Batches]:
        parts = []
        for path, size in data_files(self.path):
            # a footer per file, no data
            count = _reader(path).num_record_batches
            step = max(1, count * self.split_bytes // max(1, size))
            parts += [Batches(path, at, min(at + step, count)) for at in range(0, count, step)]
        return parts

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.fields)
        source = _reader(partition.path)
        for k in range(partition.first, partition.end):
            batch = source.get_batch(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name).cast(f.type) for f in target], schema=target)


def read_arrow_files(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
                     split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of Arrow files; a schema picks columns by name and may widen their types."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").option("splitBytes", split_bytes)
    return (reader if schema is None else reader.schema(schema)).load(path)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files of any size, read block by block in tasks."""
    listing = local_table(
        spark, [{"path": p, "size": n} for p, n in data_files(path, empty=True)],
        "path string, size bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = opened(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while block := stream.read(_BLOCK):
                        digest.update(block)
                yield pa.RecordBatch.from_pydict({"path": [name], "sha256": [digest.hexdigest()]})

    # files are few and uneven: one task each
    files = max(1, min(listing.count(), spark.sparkContext.defaultParallelism * 4))
    return listing.repartition(files, F.xxhash64("path")).select("path").mapInArrow(
        run, "path string, sha256 string")
