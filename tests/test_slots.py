"""Messages wait as rows of a key and slot of time; what operators remember goes from slot to slot and batch to batch."""

import datetime as dt

from pyspark.sql import functions as F

from spokeflow.streaming import live, ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, kind string, ts timestamp, value double"


def topic(spark, path, monkeypatch=None):
    """Messages a second apart over twenty minutes, for a lateness of a minute, in files that hold neighbouring times in any order; then a heartbeat."""
    kinds = ["view", "start", "view", "view", "view", "stop", "view", "start", "view", "start", "view", "view"]
    rows = [(k, k % 2, kinds[k // 2 % 12] if k % 2 else kinds[k // 80 % 12], START + dt.timedelta(seconds=k // 2 + k % 7), float(k % 5) if k % 9 else None) for k in range(2400)]
    for n, low in enumerate(range(0, 2400, 400)):
        part = spark.createDataFrame(rows[low : low + 400], SCHEMA)
        part.orderBy(F.hash("event_id")).coalesce(1).write.mode("append").parquet(path)
    ordered.heartbeat(spark, part.schema, "ts", START + dt.timedelta(hours=3)).coalesce(1).write.mode("append").parquet(path)
    return rows, live.replay(spark, path, part.schema)


def drained(df, path):
    return live.collected(df, f"{path}/rows", "append", f"{path}/progress").collect()


def test_gates_intervals_and_integrals_over_batches(spark, tmp_path, monkeypatch):
    met = []
    stated = ordered._stated
    monkeypatch.setattr(ordered, "_stated", lambda slots, *a: met.append(slots) or stated(slots, *a))
    rows, stream = topic(spark, f"{tmp_path}/in")
    passed, spans, sums = [], [], []
    for user in (0, 1):
        begin, held, last, total = None, [], None, 0.0
        for k, _, kind, ts, value in sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])):
            total += (value or 0.0) * (ts - last).total_seconds() if last else 0.0
            last = ts
            sums.append((k, round(total, 6)))
            if kind == "start":
                begin, held = ts, []
            elif begin and kind == "stop":
                passed += held
                spans.append((user, begin, ts))
                begin = None
            elif begin:
                held.append(k)
    args = ["user_id"], "ts", "kind", "start", "stop", "60 seconds", ["event_id"]
    assert sorted(r.event_id for r in drained(ordered.gate(stream, *args), tmp_path / "gate")) == sorted(passed) and len(passed) > 200
    assert sorted(map(tuple, drained(ordered.intervals(stream, *args), tmp_path / "spans"))) == sorted(spans) and len(spans) > 50
    out = drained(ordered.integral(stream, ["user_id"], "ts", "value", "60 seconds", ["event_id"]), tmp_path / "sums")
    assert sorted((r.event_id, round(r.position, 6)) for r in out) == sorted(sums)
    assert len(met) == 3 and all("_rows" in m.columns for m in met)  # not a message at a time
