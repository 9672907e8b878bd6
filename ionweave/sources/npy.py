"""A Spark data source for ``.npy`` arrays, standalone or inside zip archives, and offset/blob string columns.

Every range of rows is read by its own bytes of one file through pyarrow's file systems, so a file is never read whole by
one task; that holds for members stored in an archive as well. Ranges are a partition each, up to a number; many small
files share partitions. A deflated member cannot be entered in the middle: one
task reads it as a stream, a few rows at a time.
"""

import ast
import fnmatch
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: By numpy kind and size: the Arrow type that holds every value, and Spark's name of it.
TYPES = {"f8": (pa.float64(), "double"), "f4": (pa.float32(), "float"), "f2": (pa.float32(), "float"), "i8": (pa.int64(), "bigint"), "i4": (pa.int32(), "int"),
         "i2": (pa.int16(), "smallint"), "i1": (pa.int8(), "tinyint"), "u8": (pa.decimal128(20, 0), "decimal(20,0)"), "u4": (pa.int64(), "bigint"),
         "u2": (pa.int32(), "int"), "u1": (pa.int16(), "smallint"), "b1": (pa.bool_(), "boolean")}
ARCHIVES, STEP, MOST_HEADER = (".npz", ".zip"), 16_384, 1 << 20
MOST_TASKS, OPENERS = 512, 32  # of a scan: partitions, and files that are opened at a time to plan it


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system, inner


def _listed(path: str, suffix: str | tuple[str, ...]) -> list[str]:
    system, inner = _open(path)
    infos = system.get_file_info(fs.FileSelector(inner)) if system.get_file_info(inner).type == fs.FileType.Directory else [system.get_file_info(inner)]
    return sorted(i.path for i in infos if i.path.endswith(suffix))


def read_header(handle) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and data offset; object arrays and Fortran order are refused."""
    if handle.read(6) != b"\x93NUMPY":
        raise ValueError("not an npy file")
    major, _ = handle.read(2)
    length = struct.unpack("<H" if major == 1 else "<I", handle.read(2 if major == 1 else 4))[0]
    if length > MOST_HEADER:
        raise ValueError("unreasonable npy header")
    spec = ast.literal_eval(handle.read(length).decode("latin1" if major < 3 else "utf8"))
    dtype = np.dtype(spec["descr"])
    if dtype.str[1:] not in TYPES or spec["fortran_order"] or dtype.byteorder == ">" or len(spec["shape"]) not in (1, 2):
        raise ValueError("unsupported npy layout")
    return dtype, tuple(spec["shape"]), handle.tell()


Found = tuple[str, str | None, np.dtype, tuple[int, ...], bool]


def _arrays_of(system: fs.FileSystem, name: str, member: str) -> list[Found]:
    """(file, member, dtype, shape, whether it can seek) of a file's arrays, from one opening: a ``.npy`` file itself, or the members of an archive that match."""
    with system.open_input_file(name) as handle:
        if name.endswith(".npy"):
            dtype, shape, _ = read_header(handle)
            return [(name, None, dtype, shape, True)]
        out: list[Found] = []
        with zipfile.ZipFile(handle) as archive:
            for m in sorted(m for m in archive.namelist() if m.endswith(".npy") and fnmatch.fnmatchcase(m, member)):
                with archive.open(m) as stream:
                    dtype, shape, _ = read_header(stream)
                out.append((name, m, dtype, shape, _stored(archive.getinfo(m))))
        return out


def _arrays(path: str, member: str) -> Iterator[Found]:
    """Every array below ``path`` in order; files are opened as they are asked for, and many at a time."""
    system, _ = _open(path)
    names = _listed(path, (".npy", *ARCHIVES))
    with ThreadPoolExecutor(OPENERS) as pool:
        for i in range(0, len(names), 64 * OPENERS):
            for found in pool.map(lambda name: _arrays_of(system, name, member), names[i:i + 64 * OPENERS]):
                yield from found


def _first_array(path: str, member: str) -> Found:
    system, _ = _open(path)
    return next(a for name in _listed(path, (".npy", *ARCHIVES)) for a in _arrays_of(system, name, member))


def _stored(info: zipfile.ZipInfo) -> bool:
    return info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1


@contextmanager
def _opened(system: fs.FileSystem, name: str, member: str | None):
    """(handle at the start of the array, whether it can seek)."""
    with system.open_input_file(name) as handle:
        if member is None:
            yield handle, True
            return
        with zipfile.ZipFile(handle) as archive:
            info = archive.getinfo(member)
            if _stored(info):
                handle.seek(info.header_offset)
                local = handle.read(30)
                handle.seek(info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30])))
                yield handle, True
            else:
                with archive.open(info) as stream:
                    yield stream, False


class RowRange:
    def __init__(self, path: str, member: str | None, file_index: int, start: int, stop: int):
        self.path, self.member, self.file_index, self.start, self.stop = path, member, file_index, start, stop


class RowRanges(InputPartition):
    def __init__(self, ranges: list[RowRange]):
        self.ranges = ranges


def _gathered(ranges: list[RowRange], most: int) -> list[RowRanges]:
    """A partition for each range, or if they are more than ``most``, that many with neighbouring ranges of about equal rows."""
    if len(ranges) <= most:
        return [RowRanges([r]) for r in ranges]
    upto = np.cumsum([r.stop - r.start for r in ranges])
    cuts = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, most) / most, side="left") + 1)
    return [RowRanges(ranges[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranges)]) if a < b]


class NpyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.member = schema, options["path"], options.get("member", "*")
        self.rows = int(options.get("rowsPerPartition", 1_000_000))
        self.blob = options.get("kind", "array") == "blob"

    def partitions(self):
        out, kinds = [], set()
        for index, (name, member, dtype, shape, seeks) in enumerate(_arrays(self.path, self.member)):
            kinds.add((dtype, shape[1:]))
            count = shape[0] - 1 if self.blob else shape[0]
            rows = self.rows if seeks else max(count, 1)
            out += [RowRange(name, member, index, s, min(s + rows, count)) for s in range(0, count, rows)]
        if len(kinds) > 1:
            raise ValueError(f"arrays of different types or widths: {sorted(map(str, kinds))}; choose with the option member")
        return _gathered(out, MOST_TASKS)

    def _pieces(self, system: fs.FileSystem, part: RowRange, extra: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) of the range, ``STEP`` and ``extra`` overlapping rows at a time."""
        with _opened(system, part.path, part.member) as (handle, seeks):
            dtype, shape, base = read_header(handle)
            width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            for start in range(part.start, part.stop, STEP):
                stop = min(start + STEP, part.stop) + extra
                if seeks:
                    handle.seek(base + start * width)
                data = handle.read((stop - start) * width)  # a stream goes on where the last piece ended
                if len(data) != (stop - start) * width:
                    raise ValueError(f"{part.path}: the array ends early")
                yield start, np.frombuffer(data, dtype).reshape((stop - start, *shape[1:]))

    def read(self, partition: RowRanges) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for part in partition.ranges:
            yield from self._read(system, part)

    def _read(self, system: fs.FileSystem, part: RowRange) -> Iterator[pa.RecordBatch]:
        for start, rows in self._pieces(system, part, extra=int(self.blob)):
            if self.blob:
                offsets = rows.astype(np.int64)
                with system.open_input_file(part.path[:-4] + ".blob") as handle:
                    handle.seek(int(offsets[0]))
                    data = handle.read(int(offsets[-1] - offsets[0]))
                cuts = pa.py_buffer((offsets - offsets[0]).astype(np.int64).tobytes())
                values = pa.LargeStringArray.from_buffers(len(offsets) - 1, cuts, pa.py_buffer(data)).cast(pa.string())
            else:
                flat = pa.array(rows.reshape(-1).astype(np.float32) if rows.dtype.str[1:] == "f2" else rows.reshape(-1)).cast(TYPES[rows.dtype.str[1:]][0])
                values = flat if rows.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), flat)
            ids = pa.array(np.arange(start, start + len(values)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), part.file_index), pa.int32()), ids, values], names=["file_index", "row_id", "value"])


class NpySource(DataSource):
    """``format("npy")`` with options path, kind (array, blob), member (a pattern of names in archives) and rowsPerPartition."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        if self.options.get("kind", "array") == "blob":
            return "file_index int, row_id bigint, value string"
        _, _, dtype, shape, _ = _first_array(self.options["path"], self.options.get("member", "*"))
        element = TYPES[dtype.str[1:]][1]
        return f"file_index int, row_id bigint, value {element if len(shape) == 1 else f'array<{element}>'}"

    def reader(self, schema):
        return NpyReader(schema, self.options)


def scan_npy(spark: SparkSession, path: str, kind: str = "array", rows_per_partition: int = 1_000_000, member: str = "*") -> DataFrame:
    """Rows of every array below ``path`` with their position; ``kind="blob"`` reads offsets plus text, ``member`` chooses in archives."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("kind", kind).option("rowsPerPartition", rows_per_partition).option("member", member).load(path)


def _target(path: str, name: str):
    system, inner = _open(path)
    system.create_dir(inner, recursive=True)
    return system, f"{inner}/{name}"


def _receipt(part: int, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64())], names=["part", "rows"])


def _numbered(batches: Iterator[pa.RecordBatch], run: str) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file stem, partition, batch): a file for each batch, so no task holds more than one. ``run`` keeps writes apart."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, batch in enumerate(b for b in batches if b.num_rows):
        yield f"part-{part:05d}-{k:06d}-{run}", part, batch


def write_npy(df: DataFrame, column: str, path: str) -> DataFrame:
    """One ``.npy`` file per Arrow batch; returns (part, rows) when run."""
    write = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stem, part, batch in _numbered(batches, write):
            system, name = _target(path, stem + ".npy")
            with system.open_output_stream(name) as out:
                np.lib.format.write_array(out, np.array(batch.column(0).to_pylist()), allow_pickle=False)
            yield _receipt(part, batch.num_rows)

    return df.select(column).mapInArrow(run, "part int, rows bigint")


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """A column as an array of a numpy type; whole decimals as integers, without a Python object for each."""
    if not column.null_count:
        if pa.types.is_decimal(column.type) and column.type.scale == 0 and np.dtype(kind).kind in "iu":
            return pc.cast(column, pa.uint64() if np.dtype(kind).kind == "u" else pa.int64()).to_numpy().astype(kind)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type):
            return column.to_numpy(zero_copy_only=False).astype(kind)
    return np.array(column.to_pylist()).astype(kind)


def write_npz(df: DataFrame, types: dict[str, str], path: str, deflate: bool = False) -> DataFrame:
    """One archive per Arrow batch with a member for each column, of the given numpy types; returns (part, rows) when run."""
    write = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stem, part, batch in _numbered(batches, write):
            buffer = io.BytesIO()
            (np.savez_compressed if deflate else np.savez)(buffer, **{c: _numbers(batch.column(c), t) for c, t in types.items()})
            system, name = _target(path, stem + ".npz")
            with system.open_output_stream(name) as out:
                out.write(buffer.getvalue())
            yield _receipt(part, batch.num_rows)

    return df.select(*types).mapInArrow(run, "part int, rows bigint")


def write_blob(df: DataFrame, column: str, path: str) -> DataFrame:
    """Offsets ``.npy`` plus ``.blob`` text per Arrow batch; returns (part, rows) when run."""
    write = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stem, part, batch in _numbered(batches, write):
            texts = [v.encode() for v in batch.column(0).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            system, name = _target(path, stem)
            with system.open_output_stream(name + ".blob") as out:
                out.write(b"".join(texts))
            with system.open_output_stream(name + ".npy") as out:
                np.lib.format.write_array(out, offsets, allow_pickle=False)
            yield _receipt(part, len(texts))

    return df.select(column).mapInArrow(run, "part int, rows bigint")
