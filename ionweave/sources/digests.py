"""A Spark data source for the sizes and digests of files, read a block at a time."""

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .npy import _open

BLOCK = 1 << 20
PARTITION_BYTES, PARTITION_FILES = 256 << 20, 1000


class FileList(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # (path, name)


class DigestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self):
        system, root = _open(self.path)
        infos = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, self.pattern)]
        out, held, size = [], [], 0
        for info in sorted(infos, key=lambda i: i.path):
            held.append((info.path, info.path[len(root):].lstrip("/")))
            size += info.size
            if size >= PARTITION_BYTES or len(held) >= PARTITION_FILES:
                out.append(FileList(held))
                held, size = [], 0
        return [*out, FileList(held)]

    def read(self, part: FileList) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for path, name in part.files:
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
                    size += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["name", "bytes", "sha256"])


class DigestSource(DataSource):
    """``format("digests")`` with options path and pattern (of base names)."""

    @classmethod
    def name(cls):
        return "digests"

    def schema(self):
        return "name string, bytes bigint, sha256 string"

    def reader(self, schema):
        return DigestReader(self.options)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path below the folder, size and sha256 of every file in it and its subfolders."""
    spark.dataSource.register(DigestSource)
    return spark.read.format("digests").option("pattern", pattern).load(path)
