"""Operators over topics whose messages arrive out of order, by event time.

Messages of a key wait in state until the watermark has passed them and are then taken in the order of their time, so results don't
depend on how messages were dealt to batches and equal those of a batch over the same rows. A key has one timer: the time
at which its earliest waiting message is due. State holds the messages of one lateness, and what an operator remembers.

Gates, intervals and integrals let the engine's own aggregation do the waiting (`_slots`): messages of a key and a slot of time, a
quarter of the lateness, come as one row when the watermark has passed the slot. State of an operator is then what it remembers, without
timers, and a message is not handed to it one by one. Their last messages come out a slot later.

`heartbeat` messages carry no key of interest and only move the watermark on, as a live topic's clock does; a replay
ends with one, so that its last messages come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Hands the messages of a key to `take` in order; `remembered` is the state that it reads and returns."""

    remembered: str
    names: list[str]  # of the output

    def __init__(self, fields: StructType, ts: str, ties: Sequence[str]):
        self.fields, self.ts, self.ties = fields, ts, list(ties)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.memory = handle.getValueState("memory", self.remembered)

    def due(self, row: Row) -> int:
        """The millisecond at which no earlier message can come any more."""
        return math.floor(row[self.ts].timestamp() * 1000) + 1

    def take(self, memory: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def flush(self, memory: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        """What is due without a message, after all messages due up to a millisecond were taken."""
        return memory, []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = list(rows)
        self.waiting.appendList([tuple(r[f] for f in self.fields.names) for r in came])
        self._wake(min(map(self.due, came)))
        return iter(())

    def _wake(self, at: int) -> None:
        """Let the only timer stand at `at`, or earlier if it does."""
        now = list(self.handle.listTimers())
        if not now or at < min(now):
            for t in now:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = [Row(**dict(zip(self.fields.names, r))) for r in self.waiting.get()]
        ready = sorted((r for r in rows if self.due(r) <= until), key=lambda r: (r[self.ts], *((r[t] is not None, r[t]) for t in self.ties)))
        rest = [tuple(r) for r in rows if self.due(r) > until]
        self.waiting.put(rest) if rest else self.waiting.clear()
        memory, out = self.memory.get() if self.memory.exists() else None, []
        for row in ready:
            memory, made = self.take(memory, row)
            out += made
        memory, made = self.flush(memory, until)
        if memory is not None:
            self.memory.update(tuple(memory))
        if rest:
            self._wake(min(self.due(Row(**dict(zip(self.fields.names, r)))) for r in rest))
        return iter([Row(**dict(zip(self.names, (*key, *r)))) for r in (*out, *made)])


class _Gate(StatefulProcessor):
    """Of slots of messages in order: those between a start and the stop that follows it before another start; they wait for the stop."""

    names: list[str]  # of the output

    def __init__(self, held: StructType, kind: str, start: str, stop: str, spans: bool):
        self.held, self.kind, self.start, self.stop, self.spans = held, kind, start, stop, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin = handle.getValueState("begin", "at bigint")
        self.waiting = None if self.spans else handle.getListState("held", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        begin = was = self.begin.get()[0] if self.begin.exists() else None
        old, held, out = True, [], []  # whether what state holds still waits, and what waits beside it
        for slot in sorted(rows, key=lambda r: r["_slot"]):
            for row in slot["_rows"]:
                at = row["_at"]
                if row[self.kind] == self.start:
                    begin, old, held = at, False, []
                elif begin is None:
                    continue
                elif row[self.kind] == self.stop:
                    if self.spans:
                        out.append((begin, at))
                    else:
                        out += [*(map(tuple, self.waiting.get()) if old else ()), *held]
                    begin, old, held = None, False, []
                elif not self.spans:
                    held.append(tuple(row[n] for n in self.held.names))
        if begin is None:
            self.begin.clear()
        elif begin != was:
            self.begin.update((begin,))
        if not self.spans:
            if not old:
                self.waiting.clear()
            if held:
                self.waiting.appendList(held)
        made = ["begin", "end"] if self.spans else self.held.names
        return iter([Row(*self.names)(*key, [dict(zip(made, o)) for o in out])] if out else [])


class _Snapshot(_Ordered):
    """The last value of each field at every tick from the first message to the first tick at or after the last one."""

    def __init__(self, fields, ts, ties, values, width):
        super().__init__(fields, ts, ties)
        self.values, self.width = list(values), width
        kinds = {f.name: f.dataType.simpleString() for f in fields.fields}
        self.remembered = "tick bigint, " + ", ".join(f"`{v}` {kinds[v]}" for v in values)

    def tick(self, row) -> int:
        """The first tick, in units of the width, that is not before the message."""
        return -(-round(row[self.ts].timestamp() * 1_000_000) // (self.width * 1000))

    def due(self, row) -> int:
        return self.tick(row) * self.width + 1

    def take(self, memory, row):
        tick, *last = memory or (self.tick(row), *[None] * len(self.values))
        out = []
        while tick < self.tick(row):
            out.append((tick * self.width, *last))
            tick += 1
        return (tick, *(l if row[v] is None else row[v] for v, l in zip(self.values, last))), out

    def flush(self, memory, until):
        if memory is None or memory[0] * self.width >= until:
            return memory, []
        return (memory[0] + 1, *memory[1:]), [(memory[0] * self.width, *memory[1:])]


class _Integral(StatefulProcessor):
    """Of slots of messages in order the running sum of flow times the time since the message before."""

    names: list[str]  # of the output

    def __init__(self, fields: Sequence[str], flow: str, output: str):
        self.fields, self.flow, self.output = list(fields), flow, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "at bigint, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, total = self.memory.get() if self.memory.exists() else (None, 0.0)
        for slot in sorted(rows, key=lambda r: r["_slot"]):
            out = []
            for row in slot["_rows"]:
                if last is not None:
                    total += (row[self.flow] or 0.0) * ((row["_at"] - last) / 1e6)
                last = row["_at"]
                out.append({**{n: row[n] for n in self.fields}, self.output: total})
            yield Row(*self.names)(*key, out)
        self.memory.update((last, total))


SLOTS = 4  # that a lateness is parted in


def _slots(stream: DataFrame, by: Sequence[str], ts: str, late: str, ties: Sequence[str]) -> DataFrame:
    """(by.., _slot, _rows): the messages of a key and slot of time, with their microseconds and in order, once no other can come any more."""
    import pandas as pd

    width = max(1, pd.Timedelta(late) // pd.Timedelta(microseconds=1) // SLOTS)
    names = [c for c in stream.columns if c not in by]
    message = F.struct(F.unix_micros(ts).alias("_at"), *names)
    rows = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, f"{width} microseconds").alias("_w")).agg(F.collect_list(message).alias("_rows"))
    tie = lambda m, t: m[t] if t in names else F.col(t)
    place = lambda m, i: F.struct(m["_at"].alias("at"), *[x for k, t in enumerate(ties) for x in (tie(m, t).isNotNull().alias(f"n{k}"), tie(m, t).alias(f"t{k}"))], i.alias("i"))
    order = F.array_sort(F.transform("_rows", place))
    return rows.select(*by, F.unix_micros("_w.start").alias("_slot"), F.transform(order, lambda p: F.get("_rows", p["i"])).alias("_rows"))


def _stated(slots: DataFrame, by: Sequence[str], processor: _Gate | _Integral, out: StructType) -> DataFrame:
    processor.names = out.names
    slots.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return slots.groupBy(*by).transformWithState(processor, out, "append", "none")


def _run(stream: DataFrame, by: Sequence[str], ts: str, late: str | None, processor: _Ordered, out: StructType) -> DataFrame:
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)
    processor.names = out.names
    rows = stream.withWatermark(ts, late) if late else stream  # has a watermark already
    return rows.groupBy(*by).transformWithState(processor, out, "append", "eventTime")


def _parts(stream: DataFrame, by: Sequence[str]) -> tuple[list[StructField], StructType]:
    return [stream.schema[c] for c in by], StructType([f for f in stream.schema.fields if f.name not in by])


def _gated(stream: DataFrame, by: Sequence[str], ts: str, kind: str, start: str, stop: str, late: str, ties: Sequence[str], spans: bool) -> DataFrame:
    keys, fields = _parts(stream, by)
    made = StructType([StructField("begin", LongType()), StructField("end", LongType())]) if spans else fields
    processor = _Gate(fields, kind, start, stop, spans)
    out = _stated(_slots(stream, by, ts, late, ties), by, processor, StructType([*keys, StructField("_out", ArrayType(made))]))
    return out.select(*by, F.inline("_out"))


def gate(stream: DataFrame, by: Sequence[str], ts: str, kind: str, start: str, stop: str, late: str, ties: Sequence[str] = ()) -> DataFrame:
    """Messages between a start and its stop. A start before the stop begins anew, and what waited since the start before is dropped."""
    return _gated(stream, by, ts, kind, start, stop, late, ties, False)


def intervals(stream: DataFrame, by: Sequence[str], ts: str, kind: str, start: str, stop: str, late: str, ties: Sequence[str] = ()) -> DataFrame:
    """(by.., begin, end): a start with the stop that follows it before another start."""
    rows = stream.select(*by, ts, kind, *[t for t in ties if t not in (ts, kind)])
    spans = _gated(rows, by, ts, kind, start, stop, late, ties, True)
    return spans.select(*by, F.timestamp_micros("begin").alias("begin"), F.timestamp_micros("end").alias("end"))


def snapshots(stream: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], late: str, milliseconds: int = 100, ties: Sequence[str] = ()) -> DataFrame:
    """(by.., at_ms, values..): at each tick the last value of each field that a message has brought (a null brings none).

    Messages are first reduced to one a key and tick, its last values, by an aggregation of the engine. What waits in order of time is
    then a row a tick, however many messages there are.
    """
    width = milliseconds * 1000
    at = F.unix_micros(ts)
    tick = F.timestamp_micros(at + F.pmod(-at, F.lit(width)))
    place = F.struct(F.col(ts), *[F.struct(F.col(t).isNotNull(), F.col(t)) for t in ties])
    last = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(v) for v in values]
    kinds = {v: stream.schema[v].dataType for v in values}
    ticks = stream.select(*by, *values, tick.alias("_tick"), *[c for c in dict.fromkeys([ts, *ties]) if c not in (*by, *values)])
    ticks = ticks.withWatermark("_tick", late).groupBy(*by, "_tick").agg(*last)
    keys, fields = _parts(ticks, by)
    out = StructType([*keys, StructField("at_ms", LongType()), *[StructField(v, kinds[v]) for v in values]])
    return _run(ticks, by, "_tick", None, _Snapshot(fields, "_tick", (), values, milliseconds), out)


def integral(stream: DataFrame, by: Sequence[str], ts: str, flow: str, late: str, ties: Sequence[str] = (), output: str = "position") -> DataFrame:
    """The messages with the running sum of their flow over time."""
    keys, fields = _parts(stream, by)
    made = StructType([*fields.fields, StructField(output, DoubleType())])
    out = _stated(_slots(stream, by, ts, late, ties), by, _Integral(fields.names, flow, output), StructType([*keys, StructField("_out", ArrayType(made))]))
    return out.select(*by, F.inline("_out"))


def heartbeat(spark: SparkSession, schema: StructType, ts: str, at) -> DataFrame:
    """One message of no key at a time."""
    return spark.createDataFrame([tuple(at if f.name == ts else None for f in schema.fields)], StructType([StructField(f.name, f.dataType) for f in schema.fields]))
