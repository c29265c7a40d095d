"""Snapshots hold a row a tick in state, however many messages a tick has."""

import datetime as dt

from spokeflow.streaming import live, ordered


def test_messages_are_reduced_before_they_wait(spark, tmp_path, monkeypatch):
    seen = []
    run = ordered._run
    monkeypatch.setattr(ordered, "_run", lambda rows, *a: seen.append(rows) or run(rows, *a))
    start = dt.datetime(2024, 1, 1)
    rows = [(k, "a", start + dt.timedelta(milliseconds=k), float(k) if k % 3 else None, k if k % 2 else None) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp, value double, other long")
    df.repartition(2, "event_id").write.parquet(f"{tmp_path}/in")
    ordered.heartbeat(spark, df.schema, "ts", start + dt.timedelta(hours=3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ordered.snapshots(live.replay(spark, f"{tmp_path}/in", df.schema), ["kind"], "ts", ["value", "other"], "3600 seconds", 100, ["event_id"])
    out = live.collected(stream, f"{tmp_path}/rows", "append", f"{tmp_path}/progress").where("kind = 'a'").orderBy("at_ms").collect()
    first = round(start.timestamp() * 1000)
    assert [(r.at_ms - first, r.value, r.other) for r in out] == [(100, 100.0, 99), (200, 200.0, 199), (300, 299.0, 299), (400, 398.0, 399)]
    assert "Aggregate" in seen[0]._jdf.queryExecution().analyzed().toString()
