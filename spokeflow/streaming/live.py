"""The same views over live topics as structured streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spokeflow.plans.spread import in_pieces, owned, summed
from spokeflow.sources.writers import frame_json

COMMANDS = ("start", "stop", "begin", "end", "note")


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a trigger; each path is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_means(stream: DataFrame, ts: str, value: str, by: Sequence[str], width: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Means per time bin and channel; a bin is final when the watermark has passed it."""
    rows = stream.withWatermark(ts, late)
    means = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return means.select(F.col("w.start").alias("start"), *by, "mean", "n")


def latest(stream: DataFrame, by: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """The newest value of each field per channel, of several at one time the largest, for update or complete mode."""
    newest = F.max_by(F.struct(*values), F.struct(ts, *values))
    return stream.groupBy(*by).agg(F.max(ts).alias(ts), newest.alias("_v")).select(*by, ts, *[F.col(f"_v.{v}").alias(v) for v in values])


def once(stream: DataFrame, keys: Sequence[str], ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once; with a time the state is dropped behind the watermark."""
    if ts:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def commands(df: DataFrame, text: str = "value") -> DataFrame:
    """command and argument of known commands; others are dropped."""
    parts = F.split(F.trim(text), r"\s+", 2)
    return df.withColumns({"command": F.lower(parts[0]), "argument": F.get(parts, F.lit(1))}).where(F.col("command").isin(*COMMANDS))


def intervals(events: DataFrame, by: Sequence[str], ts: str, kind: str, start: str, stop: str) -> DataFrame:
    """Pairs of a start with the stop that follows it, before another start: (by.., begin, end); at one time in the order of their names.

    A key with commands of any number is taken in pieces, each with the command after it.
    """
    w = Window.partitionBy(*by, "_piece").orderBy("_rn")
    rows = in_pieces(events.where(F.col(kind).isin(start, stop)).select(*by, ts, kind), by, [ts, kind], 0, 1)
    rows = owned(rows.withColumns({"_next": F.lead(kind).over(w), "_end": F.lead(ts).over(w)}))
    return rows.where((F.col(kind) == start) & (F.col("_next") == stop)).select(*by, F.col(ts).alias("begin"), F.col("_end").alias("end"))


def gated(samples: DataFrame, spans: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Samples taken while a run was on, in a batch: by the latest interval that began before."""
    from spokeflow.operators.asof import backward

    found = backward(samples, spans, by, ts, "begin", ["begin", "end"])
    return found.where(F.col(ts) <= F.col("end")).drop("begin", "end")


def running_gate(stream: DataFrame, by: str, ts: str, kind: str, start: str, stop: str) -> DataFrame:
    """The stream of rows between start and stop commands, with one flag of state a key.

    Rows of a batch are taken in time order; the commands themselves are not passed on. A row that comes a batch late meets the
    flag as it stands by then: topics are logged in order, and for those that are not `gated` decides by event time.
    """
    import pandas as pd

    names = stream.columns
    schema = stream.schema

    def run(key, batches, state):
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        keep = []
        for k in rows[kind]:
            if k == start:
                on = True
            elif k == stop:
                on = False
            keep.append(on and k not in (start, stop))
        state.update((on,))
        yield rows[keep][names]

    return stream.groupBy(by).applyInPandasWithState(run, schema, "running boolean", "append", "NoTimeout")


def integrated(df: DataFrame, flow: str, ts: str, by: Sequence[str], output: str = "position") -> DataFrame:
    """The running sum of flow times the time since the row before, of several at one time the smaller flow first."""
    pieces = in_pieces(df, by, [ts, flow], 1)
    w = Window.partitionBy(*by, "_piece").orderBy("_rn")
    step = F.coalesce(F.col(flow) * (F.col(ts) - F.lag(ts).over(w)), F.lit(0.0))
    return summed(owned(pieces.withColumn("_step", step)), by, [ts, flow], F.col("_step"), output).drop("_step")


def thinned(df: DataFrame, ts: str, by: Sequence[str], seconds: float = 0.1) -> DataFrame:
    """The first row of each slot of some seconds."""
    slot = F.floor(F.col(ts) / seconds)
    rows = df.withColumn("_slot", slot)
    w = Window.partitionBy(*by, "_slot").orderBy(ts)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_slot")


def collected(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available into Parquet at a path that the cluster shares, and read that.

    In append mode each batch adds its rows once, by the file sink's log; in complete mode a batch is a whole table of its own
    number, of which the last counts. Nothing of it passes the driver.
    """
    spark, schema = stream.sparkSession, stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode(mode)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], schema)


class Publisher:
    """A stream of frames as JSON messages, one folder of lines a batch; stopping ends after a whole batch.

    A batch that is run again after a failure replaces its own folder, so each frame is published once.
    """

    def __init__(self, frames: DataFrame, path: str, topic: str, checkpoint: str, frame: str = "frame", data: str = "words", divisor: float = 256.0, halt: Callable[[], object] | None = None):
        def send(batch: DataFrame, number: int) -> None:
            frame_json(batch, topic, frame, data, divisor).write.mode("overwrite").text(f"{path}/batch={number}")

        self.path, self.spark, self.halt = path, frames.sparkSession, halt
        self.query = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send).start()

    def stop(self) -> None:
        """Publish what has arrived, then stop.

        `halt` fixes the source's end, so this ends however many frames keep coming. A source whose end can't be fixed is stopped
        behind the batch that it is in when this is called, or behind the next one if it is idle and has more.
        """
        if self.halt:
            self.halt()
            self.query.processAllAvailable()
        else:
            begun = -1 if self.query.lastProgress is None else self.query.lastProgress["batchId"]
            while self.query.isActive and self.query.exception() is None:
                status, last = self.query.status, self.query.lastProgress
                if last is not None and last["batchId"] > begun or not (status["isDataAvailable"] or status["isTriggerActive"]) and last is not None:
                    break
                time.sleep(0.05)
        self.query.stop()

    def messages(self) -> DataFrame:
        """What has been published, as `value`."""
        return self.spark.read.schema("value string, batch int").text(self.path).select("value")
