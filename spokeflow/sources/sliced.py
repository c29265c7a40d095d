"""Binary files of fixed-width rows, read by byte slices and written by tasks.

One file is planned as slices of its bytes, from its size alone; a task opens the file, reads the header, takes the rows that begin in its slice,
and reads those in chunks, so a file of any size goes to many tasks and none holds it whole. With `columns` only some values
of a row are returned; of arrays in column order only their bytes are read. With `only` files are chosen by name before any is opened; pushed
filters are not used for it, since a table's reader keeps those of one query for the next.

Formats, by name:

- `npy`: arrays of one or two dimensions in row or column order, numbers only;
- `points`: two little-endian int32 (points, dimensions), then float32 rows;
- `idx`: big-endian, bytes: images flat, labels as one value.

Paths are URIs that Arrow opens (`file:`, `hdfs:`, `s3:`, ...) on every machine. A writer's task writes files of at most `rows` rows under other
names; when all tasks are done the files get theirs, so a task that is lost and run again leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "spokeflow_rows"
SLICE = 16 << 20
CHUNK = 1 << 20  # bytes that are read at once
KINDS = {"npy": pa.float64(), "points": pa.float32(), "idx": pa.int32()}
_SQL = {"npy": "double", "points": "float", "idx": "int"}


@dataclass
class Layout:
    """Where the rows of a file lie."""

    start: int
    rows: int
    width: int
    dtype: np.dtype
    by_column: bool = False

    @property
    def row_bytes(self) -> int:
        return self.width * self.dtype.itemsize


def layout(kind: str, file) -> Layout:
    """From the header of an open file."""
    file.seek(0)
    if kind == "points":
        n, d = struct.unpack("<ii", file.read(8))
        return Layout(8, n, d, np.dtype("<f4"))
    if kind == "idx":
        head = file.read(4)
        if head[:2] != b"\0\0" or head[2] != 8:
            raise ValueError("only IDX files of bytes are read")
        shape = struct.unpack(f">{head[3]}i", file.read(4 * head[3]))
        return Layout(4 + 4 * head[3], shape[0], int(np.prod(shape[1:], dtype=np.int64)), np.dtype("u1"))
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    long = magic[6] > 1
    size = struct.unpack("<I" if long else "<H", file.read(4 if long else 2))[0]
    head = ast.literal_eval(file.read(size).decode("latin-1"))
    dtype, shape = np.dtype(head["descr"]), head["shape"]
    if dtype.hasobject or dtype.names or not 1 <= len(shape) <= 2:
        raise ValueError("only arrays of numbers with one or two dimensions are read")
    width = shape[1] if len(shape) == 2 else 1
    return Layout(8 + (4 if long else 2) + size, shape[0], width, dtype, head["fortran_order"] and len(shape) == 2)


@dataclass
class Slice(InputPartition):
    path: str
    low: int
    high: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.slice = options["path"], options["kind"], int(options.get("slice_bytes", SLICE))
        self.suffix = options.get("suffix", "")
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.only = set(options["only"].split("\n")) if options.get("only") else None

    def partitions(self) -> Sequence[InputPartition]:
        system, at = _opened(self.path)
        root = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(at) :].split("/"))
        files = [(root + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not hidden(f.path)]
        if self.only is not None:
            files = [f for f in files if f[0] in self.only]
        out = [Slice(path, low, min(size, low + self.slice)) for path, size in sorted(files) for low in range(0, size, self.slice)]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, at = _opened(part.path)
        with system.open_input_file(at) as file:
            form = layout(self.kind, file)
            each = max(1, form.row_bytes)
            # a row belongs to the slice that its first byte lies in; rows without bytes to the first slice
            first = max(0, -(-(part.low - form.start) // each)) if form.row_bytes else 0 if part.low == 0 else form.rows
            last = min(form.rows, max(0, -(-(part.high - form.start) // each))) if form.row_bytes else form.rows
            chosen = list(range(form.width)) if self.columns is None else [c for c in self.columns if -form.width <= c < form.width]
            step = max(1, CHUNK // each)
            for low in range(first, last, step):
                n = min(step, last - low)
                if form.by_column:
                    x = np.empty((n, len(chosen)), form.dtype)
                    for k, c in enumerate(chosen):
                        file.seek(form.start + (c % form.width * form.rows + low) * form.dtype.itemsize)
                        x[:, k] = np.frombuffer(file.read(n * form.dtype.itemsize), form.dtype)
                else:
                    file.seek(form.start + low * form.row_bytes)
                    x = np.frombuffer(file.read(n * form.row_bytes), form.dtype).reshape(n, form.width)
                    x = x if self.columns is None else x[:, chosen]
                flat = pa.array(x.ravel().astype(KINDS[self.kind].to_pandas_dtype()))
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(low, low + n)), values], names=["path", "i", "values"])


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.rows = options["path"].rstrip("/"), options["kind"], int(options.get("rows", 100_000))
        self.overwrite, self.suffix, self.run = overwrite, options.get("suffix", f".{options['kind']}"), uuid.uuid4().hex

    def _header(self, n: int, d: int) -> bytes:
        if self.kind == "points":
            return struct.pack("<ii", n, d)
        if self.kind == "idx":
            return bytes([0, 0, 8, 2]) + struct.pack(">ii", n, d) if d != 1 else bytes([0, 0, 8, 1]) + struct.pack(">i", n)
        text = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({n}, {d}), }}"
        text += " " * (-(10 + len(text) + 1) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, at = _opened(self.path)
        hidden = f"{at}/_{self.run}"
        system.create_dir(hidden, recursive=True)
        task, names, held, count = TaskContext.get(), [], [], 0
        dtype = {"npy": "<f8", "points": "<f4", "idx": "u1"}[self.kind]

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):04d}{self.suffix}"
            x = np.concatenate(held)
            with system.open_output_stream(f"{hidden}/{name}") as out:
                out.write(self._header(*x.shape) + x.astype(dtype).tobytes())
            names.append(name)

        for batch in iterator:
            lists = batch.column("values")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
            for low in range(0, len(x), self.rows):
                part = x[low : low + self.rows]
                if count + len(part) > self.rows:
                    close()
                    held, count = [], 0
                held.append(part)
                count += len(part)
        if count:
            close()
        return _Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{at}/_{self.run}/{name}", f"{at}/{self.run}-{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _opened(self.path)
        if system.get_file_info(f"{at}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_{self.run}")


class SlicedRows(DataSource):
    """Options: path, kind, suffix, slice_bytes, columns, only; for writing also rows, of a file."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"path string, i bigint, values array<{_SQL[self.options['kind']]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_rows(spark: SparkSession, path: str, kind: str, suffix: str = "", columns: Sequence[int] | None = None, slice_bytes: int = SLICE, only: Sequence[str] | None = None) -> DataFrame:
    """path, i (the row's number in its file, from 0) and values; of files with a suffix, or of some paths."""
    spark.dataSource.register(SlicedRows)
    reader = spark.read.format(NAME).option("path", path).option("kind", kind).option("suffix", suffix).option("slice_bytes", slice_bytes)
    for key, these, between in (("columns", columns, ","), ("only", only, "\n")):
        reader = reader.option(key, between.join(map(str, these))) if these else reader
    return reader.load()


def write_rows(values: DataFrame, path: str, kind: str, rows: int = 100_000, suffix: str | None = None, mode: str = "append") -> None:
    """Files of a table's one column `values`, arrays of one length."""
    values.sparkSession.dataSource.register(SlicedRows)
    writer = values.select("values").write.format(NAME).mode(mode).option("path", path).option("kind", kind).option("rows", rows)
    (writer.option("suffix", suffix) if suffix else writer).save()
