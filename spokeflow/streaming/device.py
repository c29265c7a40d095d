"""A device's frames as a stream with offsets, and folders whose files are each taken once.

A device writes a file a frame, numbered from 0 without gaps. The source's offset is the number of frames: a batch is a range of numbers,
which is read again in the same way after a failure. To stop, the end is fixed at what has come by then; frames may keep
coming, the source shows none beyond it, so a publisher can finish what was accepted and end.
"""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spokeflow.sources.readers import LISTED, below
from spokeflow.sources.sliced import _opened
from spokeflow.streaming.ordered import _PROVIDER, _ROCKS

NAME = "spokeflow_frames"
SCANS = "spokeflow_scans"
STOP = "_stop"
FRAMES = 64  # that a task reads
BACKLOG = 4  # a batch takes this part of the frames that wait, if that is more than its usual number


def frame_name(number: int) -> str:
    return f"{number:012d}.npy"


def _come(path: str) -> int:
    """Frames that have come: a file counts when all before it are there."""
    system, at = _opened(path)
    found = sorted(int(f.base_name[:-4]) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".npy"))
    return next((k for k, n in enumerate(found) if n != k), len(found))


def fix_end(path: str) -> int:
    """Stop the source at the frames that have come; returns how many. An end that is fixed already stays."""
    system, at = _opened(path)
    if (end := _fixed(path)) is None:
        end = _come(path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{STOP}") as out:
            out.write(str(end).encode())
    return end


def release(path: str) -> None:
    """Let the source go on beyond a fixed end."""
    system, at = _opened(path)
    if _fixed(path) is not None:
        system.delete_file(f"{at}/{STOP}")


def _fixed(path: str) -> int | None:
    system, at = _opened(path)
    if system.get_file_info(f"{at}/{STOP}").type != fs.FileType.File:
        return None
    with system.open_input_file(f"{at}/{STOP}") as f:
        return int(f.read() or b"0")


@dataclass
class _Range(InputPartition):
    first: int
    stop: int


class _FrameReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("frames_per_batch", 10_000))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        end = _fixed(self.path)
        come = _come(self.path) if end is None else end
        self.seen = min(come, self.seen + max(self.most, (come - self.seen) // BACKLOG))
        return {"frames": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.seen = max(self.seen, end["frames"])  # after a restart the log knows more
        return [_Range(k, min(end["frames"], k + FRAMES)) for k in range(start["frames"], end["frames"], FRAMES)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, at = _opened(self.path)
        for k in range(part.first, part.stop):
            with system.open_input_file(f"{at}/{frame_name(k)}") as f:
                words = np.load(io.BytesIO(f.read()), allow_pickle=False)
            rows = pa.array([words.astype(float).tolist()], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array([k]), rows], names=["frame", "words"])

    def commit(self, end: dict) -> None:
        return None


class DeviceFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "frame bigint, words array<array<double>>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameReader(self.options)


def device_frames(spark: SparkSession, path: str, frames_per_batch: int = 10_000) -> DataFrame:
    """The stream (frame, words) of a device's folder, some frames a batch, or a part of those that wait if that is more.

    So the batches of a backlog grow with its logarithm; a task still reads FRAMES frames of whatever a batch holds.
    """
    spark.dataSource.register(DeviceFrames)
    return spark.readStream.format(NAME).option("path", path).option("frames_per_batch", frames_per_batch).load()


class _ScanReader(DataSourceStreamReader):
    """A folder that is looked through: the offset is the millisecond of a look, a batch is what lies in the folder by then."""

    def __init__(self, options):
        self.path, self.pattern = options["path"].rstrip("/"), options["pattern"]
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.seen = max(self.seen + 1, time.time_ns() // 1_000_000)
        return {"at": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.seen = max(self.seen, end["at"])
        return [_Range(start["at"], end["at"])]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, at = _opened(self.path)
        found = below(system, at, self.pattern)
        for low in range(0, len(found), LISTED):
            paths, folders = zip(*found[low : low + LISTED])
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(folders)], names=["path", "folder"])

    def commit(self, end: dict) -> None:
        return None


class FolderScans(DataSource):
    @classmethod
    def name(cls) -> str:
        return SCANS

    def schema(self) -> str:
        return "path string, folder boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ScanReader(self.options)


def _head(path: str) -> str:
    """What stands before the paths of Arrow to make them URIs."""
    system, at = _opened(path)
    return "file://" if system.type_name == "local" else path[: len(path) - len(at)] if path.endswith(at) else ""


def _appeared(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The stream of paths of the files below a folder, each once.

    Tasks list the folders, those of the first two levels dealt anew. The log of the paths that were taken is the state of
    the stream, which tasks hold in shares, so the driver knows of no path; a look at the folder is a batch of its own.
    """
    system, at = _opened(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)

    def listing(whole: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            there, _ = _opened(path)
            for pdf in batches:
                held = []
                for name, folder in zip(pdf["path"], pdf["folder"]):
                    stack = [(name, folder)]
                    while stack:
                        found, inside = stack.pop()
                        if inside:
                            more = below(there, found, pattern)
                            (stack if whole else held).extend(more)
                        else:
                            held.append((found, False))
                        if len(held) >= LISTED:
                            yield pd.DataFrame(held, columns=["path", "folder"])
                            held = []
                yield pd.DataFrame(held, columns=["path", "folder"])

        return run

    spark.dataSource.register(FolderScans)
    spark.conf.set(_PROVIDER, _ROCKS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.readStream.format(SCANS).option("path", path).option("pattern", pattern).load()
    for whole in (False, True):
        level = level.repartition(parts, "path").mapInPandas(listing(whole), "path string, folder boolean")
    return level.select(F.concat(F.lit(_head(path)), "path").alias("path")).dropDuplicates(["path"])


def watched(spark: SparkSession, path: str, parse: Callable[[bytes], dict[str, float]], pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of one row for each file that appears below a folder: path, values, and the error of one that cannot be parsed.

    The stream's state holds the paths it has taken, over restarts too, and each path counts once. A file that fails is a row as well: it is
    logged by its error and not tried again. Each trigger looks through the folder once and takes all that is new, a file at a time in a task.
    Paths that Arrow cannot open are listed by Spark's own source, `files_per_trigger` at a time, and its log holds them.
    """

    def parsed(name: str, content: Callable[[], bytes]) -> tuple:
        try:
            return name, {k: float(v) for k, v in parse(content()).items()}, None
        except Exception as failed:  # whatever a file holds, others go on
            return name, None, f"{type(failed).__name__}: {failed}"

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def content(name: str) -> bytes:
            with system.open_input_file(name[len(head) :]) as f:
                return f.read()

        system, head = _opened(path)[0], _head(path)
        for pdf in batches:
            yield pd.DataFrame([parsed(p, lambda p=p: content(p)) for p in pdf["path"]], columns=["path", "values", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parsed(p, lambda c=c: bytes(c)) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "values", "error"])

    schema = "path string, values map<string,double>, error string"
    try:
        _opened(path)
    except (pa.ArrowException, ValueError, OSError):
        spark.conf.set("spark.sql.streaming.schemaInference", "false")
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        files = files.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
        return files.select(F.col("_metadata.file_path").alias("path"), "content").mapInPandas(run, schema)
    return _appeared(spark, path, pattern).mapInPandas(opened, schema)
