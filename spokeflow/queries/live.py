"""Streams over replayed events, drained and compared with the same views in a batch."""

from __future__ import annotations

import datetime
import io
import uuid

import numpy as np
from pyspark.sql import functions as F

from spokeflow.plans.lineage import shared_folder
from spokeflow.queries import EV, PX, events, pixels, query, r6, table
from spokeflow.sources import readers
from spokeflow.sources.writers import write_texts
from spokeflow.streaming import device, live, ordered


def _replayed(spark, sf, parts: int = 3):
    path = f"{shared_folder(spark)}/topic-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(parts, "ts").write.parquet(path)
    return live.replay(spark, path, e.schema)


def _shuffled(spark, rows, parts: int = 4):
    """A topic of rows with `ts` whose files hold any of its times, and a heartbeat after all of them; and the lateness that covers it."""
    path = f"{shared_folder(spark)}/topic-{uuid.uuid4().hex}"
    rows.repartition(parts, "event_id").write.parquet(path)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    late = datetime.timedelta(seconds=1) + (last - first if first else datetime.timedelta(0))
    ordered.heartbeat(spark, rows.schema, "ts", (last or datetime.datetime(2000, 1, 1)) + 2 * late).coalesce(1).write.mode("append").parquet(path)
    return live.replay(spark, path, rows.schema), f"{late.total_seconds():.6f} seconds"


def _drained(df, mode: str):
    """What the stream leaves in the shared folder, with its state and progress beside it."""
    place = f"{shared_folder(df.sparkSession)}/live-{uuid.uuid4().hex}"
    return live.collected(df, f"{place}/rows", mode, f"{place}/progress")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def stream_bins(spark, sf):
    out = _drained(live.tumbling_means(_replayed(spark, sf), "ts", "value", ["event_type"], "1 hour"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("mean", 6).alias("mean"), "n")


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def stream_latest(spark, sf):
    out = _drained(live.latest(_replayed(spark, sf), ["user_id"], "ts", ["value", "event_type"]), "complete")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, sf):
    return _drained(live.once(_replayed(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"]), "append")


_PAIRS = f"""(SELECT user_id, t AS begin_at, n AS end_at FROM (SELECT user_id, t, event_type, lead(event_type) OVER w AS k, lead(t) OVER w AS n FROM {EV} WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE event_type = 'click' AND k = 'error')"""


@query(f'SELECT user_id, begin_at AS "begin", end_at AS "end" FROM {_PAIRS}')
def start_stop_intervals(spark, sf):
    return live.intervals(events(spark, sf), ["user_id"], "t", "event_type", "click", "error")


@query(f"""SELECT event_id FROM {EV} e ASOF JOIN {_PAIRS} p ON e.user_id = p.user_id AND e.t >= p.begin_at WHERE e.event_type = 'view' AND e.t <= p.end_at""")
def gated_samples(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "event_type", "t", "value")
    spans = live.intervals(e, ["user_id"], "t", "event_type", "click", "error")
    return live.gated(e.where("event_type = 'view'"), spans, ["user_id"], "t").select("event_id")


@query("""WITH e AS (SELECT *, max(CASE WHEN event_type = 'click' THEN ts END) OVER w AS a, max(CASE WHEN event_type = 'error' THEN ts END) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id FROM e WHERE event_type NOT IN ('click', 'error') AND a IS NOT NULL AND (b IS NULL OR a > b)""")
def stream_gate(spark, sf):
    """Rows between a start and a stop command, with a flag of state a run."""
    rows = _replayed(spark, sf, 1).select("event_id", "user_id", "event_type", "ts")
    return _drained(live.running_gate(rows, "user_id", "ts", "event_type", "click", "error"), "append").select("event_id")


@query("SELECT event_id, 'start' AS command, event_type AS argument FROM events WHERE user_id % 2 = 0")
def parsed_commands(spark, sf):
    word = F.when(F.col("user_id") % 2 == 0, "Start ").otherwise("fly ")
    e = events(spark, sf).select("event_id", F.concat(word, "event_type").alias("value"))
    return live.commands(e).select("event_id", "command", "argument")


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(t / 86400) ORDER BY t) AS n FROM {EV}) WHERE n = 1")
def thinned_samples(spark, sf):
    return live.thinned(events(spark, sf), "t", ["user_id"], 86400.0).select("event_id")


@query("SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS d, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def stream_means_of_mean(spark, sf):
    out = _drained(live.tumbling_means(_replayed(spark, sf), "ts", "value", ["event_type"], "1 day"), "complete")
    return out.groupBy("event_type").agg(r6(F.avg("mean")).alias("mean"))


def _filmed(frames, path: str) -> None:
    """A file a frame, numbered from 0: tables number frames so."""

    def run(batches):
        from spokeflow.sources.sliced import _opened

        system, at = _opened(path)
        system.create_dir(at, recursive=True)
        for pdf in batches:
            for number, words in zip(pdf["frame"], pdf["words"]):
                held = io.BytesIO()
                np.save(held, np.array([list(r) for r in words], float))
                with system.open_output_stream(f"{at}/_{number}") as out:
                    out.write(held.getvalue())
                system.move(f"{at}/_{number}", f"{at}/{device.frame_name(number)}")
            yield pdf[["frame"]]

    frames.mapInPandas(run, "frame bigint").count()


@query("""SELECT user_id, CASE WHEN user_id % 7 > 0 THEN count(*) END AS n, CASE WHEN user_id % 7 > 0 THEN round(sum(round(value, 3)), 3) + 0.0 END AS total, user_id % 7 = 0 AS failed FROM events GROUP BY user_id""")
def watched_files(spark, sf):
    """A folder with a file of numbers a user, each parsed once; those of some users are broken and come as errors."""
    place = f"{shared_folder(spark)}/watched-{uuid.uuid4().hex}"
    number = F.when(F.col("user_id") % 7 == 0, F.lit("broken")).otherwise(F.round("value", 3).cast("string"))
    texts = table(spark, sf, "events").groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(number)).alias("value"))
    name = F.concat(F.lit("user_id="), F.coalesce(F.col("user_id").cast("string"), F.lit("none")), F.lit("/part.txt"))
    write_texts(texts.select(name.alias("name"), "value"), f"{place}/in")

    def parse(content: bytes) -> dict[str, float]:
        numbers = [float(x) for x in content.decode().split()]
        return {"n": len(numbers), "total": sum(numbers)}

    found = live.collected(device.watched(spark, f"{place}/in", parse, "*.txt"), f"{place}/rows", "append", f"{place}/progress")
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("bigint")
    return found.select(user.alias("user_id"), F.col("values")["n"].cast("bigint").alias("n"), (F.round(F.col("values")["total"], 3) + 0.0).alias("total"), F.col("error").isNotNull().alias("failed"))


@query(f"""SELECT t AS frame, 'scan' AS topic, 16 AS x_coils, 4 AS y_coils, round(sum(p) / 256, 6) + 0.0 AS total FROM {PX} GROUP BY 1""")
def stream_publish(spark, sf):
    """A device's frames, published as messages until the stream is stopped, and read again."""
    px = pixels(spark, sf)
    rows = px.groupBy("t", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "p"))), lambda c: c["p"]).alias("r"))
    words = rows.groupBy(F.col("t").alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda c: c["r"]).alias("words"))
    place = f"{shared_folder(spark)}/publish-{uuid.uuid4().hex}"
    _filmed(words, f"{place}/device")
    frames = device.device_frames(spark, f"{place}/device", 200)
    publisher = live.Publisher(frames, f"{place}/messages", "scan", f"{place}/progress", halt=lambda: device.fix_end(f"{place}/device"))
    publisher.stop()
    back = readers.frame_messages(publisher.messages())
    total = F.aggregate(F.flatten("frame_data"), F.lit(0.0), lambda a, b: a + b)
    return back.select("frame", "topic", "x_coils", "y_coils", r6(total).alias("total"))


def _messages(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


@query(f"""SELECT event_id FROM {EV} e ASOF JOIN {_PAIRS} p ON e.user_id = p.user_id AND e.t >= p.begin_at WHERE e.event_type NOT IN ('click', 'error') AND e.t <= p.end_at""")
def stream_ordered_gate(spark, sf):
    """Messages between a start and its stop, from files that hold any times."""
    stream, late = _shuffled(spark, _messages(spark, sf))
    return _drained(ordered.gate(stream, ["user_id"], "ts", "event_type", "click", "error", late, ["event_type", "event_id"]), "append").select("event_id")


@query(f'SELECT user_id, round(begin_at, 3) AS "begin", round(end_at, 3) AS "end" FROM {_PAIRS}')
def stream_intervals(spark, sf):
    stream, late = _shuffled(spark, _messages(spark, sf))
    out = _drained(ordered.intervals(stream, ["user_id"], "ts", "event_type", "click", "error", late, ["event_type"]), "append")
    return out.select("user_id", *[F.round(F.unix_micros(c) / 1e6, 3).alias(c) for c in ("begin", "end")])


@query(f"""SELECT event_id, round(sum(value * d) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS position FROM
(SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS d FROM {EV})""")
def stream_position(spark, sf):
    stream, late = _shuffled(spark, _messages(spark, sf))
    out = _drained(ordered.integral(stream, ["user_id"], "ts", "value", late, ["event_id"]), "append").where("user_id is not null")
    return out.select("event_id", (F.round("position", 3) + 0.0).alias("position"))


#: Time runs so much faster in the replay of snapshots that their grid of 100 ms suits the events' spacing.
_SPEED = 10_000
_FAST = f"(SELECT event_id, event_type, CASE WHEN user_id % 3 > 0 THEN value END AS value, CASE WHEN user_id % 2 > 0 THEN user_id END AS user_id, (epoch_us(ts) // {_SPEED})::BIGINT AS us FROM events)"


@query(f"""WITH e AS {_FAST}, b AS (SELECT event_type, min(ceil(us / 100000.0)::BIGINT) AS lo, max(ceil(us / 100000.0)::BIGINT) AS hi FROM e GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi)) AS k FROM b),
v AS (SELECT g.event_type, g.k, x.value FROM g ASOF LEFT JOIN (SELECT event_type, us, arg_max(value, event_id) AS value FROM e WHERE value IS NOT NULL GROUP BY 1, 2) x ON x.event_type = g.event_type AND g.k * 100000 >= x.us)
SELECT v.event_type, v.k * 100 AS at_ms, v.value, x.user_id FROM v ASOF LEFT JOIN (SELECT event_type, us, arg_max(user_id, event_id) AS user_id FROM e WHERE user_id IS NOT NULL GROUP BY 1, 2) x ON x.event_type = v.event_type AND v.k * 100000 >= x.us""")
def stream_snapshots(spark, sf):
    """Ten times a second the last value of each field per channel."""
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts")) / _SPEED))
    rows = _messages(spark, sf).select(
        "event_id", "event_type", fast.alias("ts"), F.when(F.col("user_id") % 3 > 0, F.col("value")).alias("value"), F.when(F.col("user_id") % 2 > 0, F.col("user_id")).alias("user_id")
    )
    stream, late = _shuffled(spark, rows)
    return _drained(ordered.snapshots(stream, ["event_type"], "ts", ["value", "user_id"], late, 100, ["event_id"]), "append").where("event_type is not null")
