"""Sinks: run store, pressure text, JSON frames, cluster files, metrics and annotations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.functions.scalars import COLUMNS


def write_runs(df: DataFrame, path: str, run: str = "run_id") -> None:
    """A table of runs as Parquet, one folder a run, so a read of some runs touches only theirs."""
    df.repartition(run).write.mode("overwrite").partitionBy(run).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pressure_lines(pixels: DataFrame, keys: list[str], ts: str = "ts", columns: int = COLUMNS, rows: int = 20) -> DataFrame:
    """(keys, text): frames in the format that `pressure_text` reads."""
    line = pixels.groupBy(*keys, ts, "row").agg(F.array_sort(F.collect_list(F.struct("col", "p"))).alias("_c"))
    line = line.withColumn("_t", F.concat_ws("\t", (F.lit(rows) - F.col("row")).cast("string"), F.transform("_c", lambda c: c["p"].cast("string"))))
    body = line.groupBy(*keys, ts).agg(F.array_sort(F.collect_list(F.struct((-F.col("row")).alias("o"), F.col("_t").alias("t")))).alias("_l"))
    stamp = F.date_format(F.timestamp_micros(F.round(F.col(ts) * 1_000_000).cast("bigint")), "yyyy/MM/dd HH:mm:ss.SSSSSS")
    head = F.concat_ws("\t", F.lit("amp"), F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: i.cast("string")))
    return body.select(*keys, ts, F.concat_ws("\n", F.concat(F.lit("timestamp="), stamp), head, F.concat_ws("\n", F.transform("_l", lambda x: x["t"]))).alias("text"))


def write_pressure(lines: DataFrame, path: str) -> None:
    lines.select("text").write.mode("overwrite").text(path)


def frame_json(frames: DataFrame, topic: str, frame: str = "frame", data: str = "words", divisor: float = 256.0) -> DataFrame:
    """Frames of raw words (array of rows) as published messages; a word is 1/256 of a unit."""
    rows = F.transform(data, lambda r: F.struct(F.transform(r, lambda w: w / F.lit(divisor)).alias("xCoil")))
    message = F.struct(
        F.lit("publish").alias("op"), F.lit(topic).alias("topic"),
        F.struct(F.col(frame).alias("frameNumber"), F.size(F.col(data)[0]).alias("xCoils"), F.size(data).alias("yCoils"), rows.alias("frameData")).alias("msg"),
    )
    return frames.select(F.to_json(message).alias("value"))


def write_texts(files: DataFrame, path: str) -> None:
    """A text file for each row (name, value), the name with its folders below the path.

    Tasks write their files themselves under hidden names and rename them, so nothing is left to be moved one after another
    by the driver, and a task that is run again replaces its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from spokeflow.sources.sliced import _opened

        system, at = _opened(path)
        for pdf in batches:
            for name, value in zip(pdf["name"], pdf["value"]):
                folder, own = f"{at}/{name}".rsplit("/", 1)
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(f"{value}\n".encode())
                system.move(hidden, f"{folder}/{own}")
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("name", "value").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def write_clusters(clusters: DataFrame, path: str) -> None:
    """`id cluster` lines; noise is -1."""
    clusters.select(F.concat_ws(" ", F.col("id").cast("string"), F.coalesce("cluster", F.lit(-1)).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_notes(notes: DataFrame, path: str) -> None:
    """Run annotations as JSON."""
    notes.write.mode("overwrite").json(path)


def run_notes(notes: DataFrame, marks: DataFrame, run: str, kind: str, ts: str, start: str = "start", stop: str = "end") -> DataFrame:
    """Nested annotations, one row a run: its notes, and run_features_time with the times at which each feature starts and ends.

    `marks` are (run, kind, sign, ts) rows, the sign `start` or `stop`; times of a feature are in order.
    """
    of = lambda sign: F.array_sort(F.collect_list(F.when(F.col("sign") == sign, F.col(ts))))
    per = marks.where(F.col("sign").isin(start, stop)).groupBy(run, kind).agg(of(start).alias("s"), of(stop).alias("e"))
    names = F.array(F.concat(kind, F.lit(f"_{start}")), F.concat(kind, F.lit(f"_{stop}")))
    entry = F.map_from_arrays(names, F.array("s", "e"))
    times = per.groupBy(run).agg(F.array_sort(F.flatten(F.collect_list(F.map_entries(entry)))).alias("_t")).withColumn("_t", F.map_from_entries("_t"))
    own = [c for c in notes.columns if c != run]
    out = notes.join(times.withColumnRenamed(run, "_of"), notes[run].eqNullSafe(F.col("_of")), "left")
    return out.select(F.col(run), *own, F.col("_t").alias("run_features_time"))


def write_forest(nodes: DataFrame, path: str) -> None:
    """A forest's node table."""
    nodes.write.mode("overwrite").parquet(path)
