"""Readers of sensor files. Each file is a row, parsed where it lies; frames and samples come out as rows."""

from __future__ import annotations

import fnmatch
import io
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spokeflow.functions.scalars import COLUMNS, parse_stamp, run_fields
from spokeflow.plans.lineage import written
from spokeflow.sources.sliced import _opened


def _files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


LISTED = 4096  # paths that a task hands on at once
READ = 4 << 20  # bytes of files that are held at once, about


def below(system: fs.FileSystem, folder: str, pattern: str) -> list[tuple[str, bool]]:
    """What lies in a folder and whether it is a folder: its folders, and its files whose names fit; hidden ones are left out."""
    found = [f for f in system.get_file_info(fs.FileSelector(folder)) if not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name)]
    return [(f.path, f.type == fs.FileType.Directory) for f in found if f.type == fs.FileType.Directory or fnmatch.fnmatchcase(f.base_name, pattern)]


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path of the files below a folder whose names fit a pattern, as Spark's readers name them; hidden ones are left out.

    Folders are listed by tasks, a level at a time, and the paths stay in a written table, so the driver holds none of them. Paths that Arrow
    cannot open are listed by Spark's own reader.
    """
    try:
        system, at = _opened(root)
    except (pa.ArrowException, ValueError, OSError):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    head = "file:" if system.type_name == "local" else root[: len(root) - len(at)] if root.endswith(at) else ""
    if system.get_file_info(at).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, _ = _opened(root)
        for pdf in batches:
            for folder in pdf["path"]:
                rows = below(there, folder, pattern)
                for low in range(0, len(rows), LISTED):
                    yield pd.DataFrame(rows[low : low + LISTED], columns=["path", "folder"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([(at.rstrip("/") or "/",)], "path string"), None
    while True:
        found = written(level.mapInPandas(run, "path string, folder boolean"))
        here = found.where("not folder").select(F.concat(F.lit(head), "path").alias("path"))
        files = here if files is None else files.unionByName(here)
        if found.where("folder").isEmpty():
            return files
        level = found.where("folder").select("path").repartition(parts, "path")


def contents(paths: DataFrame) -> DataFrame:
    """(path, content) of files, read by tasks, some at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for path in pdf["path"]:
                system, at = _opened(path)
                with system.open_input_file(at) as f:
                    held.append((path, f.read()))
                size += len(held[-1][1])
                if size >= READ:
                    yield pd.DataFrame(held, columns=["path", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "content"])

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartition(parts, "path").mapInPandas(run, "path string, content binary")


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Runs found below a folder: path, name and the fields of the name; sorted."""
    name = F.element_at(F.split("path", "/"), -2)
    runs = listed(spark, root, pattern).withColumn("run", name)
    return runs.select("path", "run", *[c.alias(k) for k, c in run_fields(F.col("run")).items()]).orderBy("path")


def pressure_text(spark: SparkSession, path: str | Sequence[str], columns: int = COLUMNS) -> DataFrame:
    """path, frame, ts, row, col, p from text where a `timestamp=` line opens a frame.

    Data lines have columns + 1 tab fields, the first the row from 1; a header line starts with `amp`. The row
    becomes rows - row, which turns the grid upright.
    """
    lines = _files(spark, path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("n", "line"))
    opens = F.col("line").startswith("timestamp=")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stamped = lines.withColumns({
        "frame": F.sum(opens.cast("int")).over(w) - 1,
        "ts": F.last(F.when(opens, parse_stamp(F.trim(F.substring_index("line", "=", -1)))), ignorenulls=True).over(w),
        "fields": F.split("line", "\t"),
    })
    data = stamped.where((F.size("fields") == columns + 1) & (F.col("fields")[0] != "amp") & (F.col("frame") >= 0))
    cells = data.select("path", "frame", "ts", F.col("fields")[0].cast("int").alias("xi"), F.posexplode(F.slice("fields", 2, columns)).alias("col", "v"))
    top = F.max("xi").over(Window.partitionBy("path"))
    return cells.select("path", "frame", "ts", (top - F.col("xi")).alias("row"), "col", F.expr("try_cast(v AS double)").alias("p"))


def impedance(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """path, exp_time, peaks, timesteps, times, primary and pretreat lists of (re, im, freq) of `.idf` files.

    A block starts at a line with its name, two lines on stands its count, then rows of three numbers.
    Absent keys are NULL. With a pattern a folder's files of such names are listed and read by tasks.
    """
    files = _files(spark, path) if pattern is None else contents(listed(spark, path, pattern))
    text = files.withColumn("text", F.decode("content", "UTF-8"))
    one = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))

    def block(name: str):
        rows = F.split(F.regexp_extract("text", rf"(?is)(?:^|\n){name}[^\n]*\n[^\n]*\n\s*\d+[^\n]*\n((?:\s*[-+0-9.eE]+[ \t]+[-+0-9.eE]+[ \t]+[-+0-9.eE]+[^\n]*(?:\n|$))+)", 1), "\n")
        parts = F.transform(F.filter(rows, lambda r: F.trim(r) != ""), lambda r: F.split(F.trim(r), r"\s+"))
        return F.when(
            F.size(parts) > 0, F.transform(parts, lambda p: F.struct(*[p[i].cast("double").alias(n) for i, n in enumerate(("re", "im", "freq"))]))
        )

    times = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^timing\.time\[\d+\]\s*=\s*([-+0-9.eE]+)"), 1), lambda t: t.cast("double"))
    start = one(r"(?m)^starttime\s*=\s*([^\r\n]+)")
    return text.select(
        "path", (F.unix_micros(F.try_to_timestamp(start, F.lit("M/d/yyyy h:mm:ss a"))) / 1e6).alias("exp_time"),
        F.when(one(r"(?mi)^Peaks\s*=\s*(\S+)").isNotNull(), F.lower(one(r"(?mi)^Peaks\s*=\s*(\S+)")).isin("1", "true", "yes")).alias("peaks"),
        F.expr(r"try_cast(nullif(regexp_extract(text, '(?m)^timing\\s*=\\s*(\\d+)', 1), '') AS int)").alias("timesteps"),
        F.when(F.size(times) > 0, times).alias("times"), block("primary_data").alias("primary"), block("pretreatmentdata").alias("pretreat"),
    )


def arrays(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.npy") -> DataFrame:
    """path, i, values from `.npy` files of one or two dimensions; object arrays are refused."""
    return arrays_of(_files(spark, path, pattern))


def arrays_of(files: DataFrame) -> DataFrame:
    """`arrays` of files already read as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(float)
                yield pd.DataFrame({"path": p, "i": np.arange(len(x)), "values": list(x)})

    return files.mapInPandas(run, "path string, i bigint, values array<double>")


#: Suffix of a sensor's file, its channel, and the columns taken beside the first, the time; -1 is the last.
SENSORS = [("wheel_v3", "rho", -1), ("wheel", "rho", -1), ("slip_sp", "slip", -1), ("slip", "slip", -1), ("ati", "ft", None), ("cart", "sink", 2), ("cart", "current", 3)]


def sensor_stream(samples: DataFrame) -> DataFrame:
    """(run, channel, ts, value) from `arrays`; forces give six channels ft_0 to ft_5.

    Where a run has files of two generations for a channel the first in SENSORS counts. That is settled among the files; samples then
    meet the channels of their own file only.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    rules = []
    for rank, (suffix, channel, at) in enumerate(SENSORS):
        taken = [(f"ft_{i}", i + 1) for i in range(6)] if at is None else [(channel, at)]
        each = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("at"), F.lit(rank).alias("rank")) for c, k in taken])
        rules.append(F.when(stem.endswith(suffix), each).otherwise(F.array().cast("array<struct<channel:string,at:int,rank:int>>")))
    rows = samples.where(F.size("values") > 1)
    files = rows.select("path").distinct().select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("run"), F.explode(F.concat(*rules)).alias("s")).select("path", "run", "s.*")
    files = files.withColumn("best", F.min("rank").over(Window.partitionBy("run", "channel"))).where("rank = best")
    files = files.groupBy("path", "run").agg(F.collect_list(F.struct("channel", "at")).alias("s"))  # the channels of a file are few
    v = F.col("values")
    met = rows.join(files, "path").select("run", v, F.explode("s").alias("s"))
    return met.select("run", "s.channel", v[0].alias("ts"), F.when(F.col("s.at") < 0, F.element_at(v, -1)).otherwise(F.get(v, F.col("s.at"))).alias("value"))


def rock_labels(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, ts, rock, rock_depth: time written a_b for a.b, flags in between, depth last; `Nan` and a lone dot are 0."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 3")
    zero = lambda c: F.when(F.lower(c).isin("nan", "."), F.lit("0")).otherwise(c)
    flags = F.transform(F.slice("f", 2, F.size("f") - 2), lambda c: zero(c).cast("int"))
    return lines.select(
        "path", F.regexp_replace(F.col("f")[0], "_", ".").cast("double").alias("ts"), F.aggregate(flags, F.lit(0), lambda a, b: a + b).alias("rock"),
        zero(F.element_at("f", -1)).cast("double").alias("rock_depth"),
    )


def points_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, id, features of white-space separated numbers; id is the line in its file, from 0."""
    lines = _files(spark, path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("n", "line")).where("trim(line) <> ''")
    return lines.select("path", F.col("n").cast("bigint").alias("id"), F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("features"))


def points_binary(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, id, features: two int32 (points, dimensions), then float32 rows."""
    return points_binary_of(_files(spark, path))


def points_binary_of(files: DataFrame) -> DataFrame:
    """`points_binary` of files already read as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                n, d = struct.unpack_from("<ii", content)
                x = np.frombuffer(content, "<f4", n * d, 8).reshape(n, d)
                for at in range(0, n, 10_000):
                    part = x[at : at + 10_000]
                    yield pd.DataFrame({"path": p, "id": np.arange(at, at + len(part)), "features": list(part)})

    return files.mapInPandas(run, "path string, id bigint, features array<float>")


def idx(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, i, values of IDX files (big-endian, bytes): images flat, labels as one value."""
    return idx_of(_files(spark, path))


def idx_of(files: DataFrame) -> DataFrame:
    """`idx` of files already read as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                dims = content[3]
                shape = struct.unpack_from(f">{dims}i", content, 4)
                x = np.frombuffer(content, np.uint8, int(np.prod(shape)), 4 + 4 * dims).reshape(shape[0], -1)
                yield pd.DataFrame({"path": p, "i": np.arange(len(x)), "values": list(x.astype(np.int32))})

    return files.mapInPandas(run, "path string, i bigint, values array<int>")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table or a query in parentheses over JDBC; with a numeric key it is read in `parts` ranges of it at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """Feature names, one a line, or those marked 1 in a YAML mapping."""
    lines = [r.value.strip() for r in spark.read.text(path).collect()]
    if any(line.endswith(":") for line in lines):
        pairs = [line.split(":", 1) for line in lines if ":" in line and not line.endswith(":")]
        return [k.strip().strip("'\"") for k, v in pairs if v.strip() == "1"]
    return [line for line in lines if line and not line.startswith("#")]


def frame_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Published JSON frames back as rows: topic, frame, x_coils, y_coils, frame_data."""
    schema = "struct<op:string,topic:string,msg:struct<frameNumber:bigint,xCoils:int,yCoils:int,frameData:array<struct<xCoil:array<double>>>>>"
    m = F.from_json(F.col(column), schema)
    return messages.select(m.alias("m")).where("m.msg is not null").select(
        F.col("m.topic").alias("topic"), F.col("m.msg.frameNumber").alias("frame"), F.col("m.msg.xCoils").alias("x_coils"),
        F.col("m.msg.yCoils").alias("y_coils"), F.transform("m.msg.frameData", lambda r: r["xCoil"]).alias("frame_data"),
    )
