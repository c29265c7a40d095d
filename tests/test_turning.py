import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.operators import signal, turning
from spokeflow.queries import time as queries
from tests import oracle


def wheel(n, seed):
    """A wheel that stands, turns and stands; with noise, or without any stop, as the seed has it."""
    r = np.random.default_rng(seed)
    low, high = sorted(r.integers(0, n + 1, 2).tolist())
    at = np.clip(np.arange(n), low, high if seed % 3 else n) - low
    return (at * 3.7 + (r.normal(0, 0.3, n) if seed % 4 == 3 else 0)) % 360


def test_against_the_plain_detector(spark):
    runs = {f"r{i}": wheel(n, i) for i, n in enumerate([1, 2, 3, 29, 31, 60, 200, 400, 400, 400, 777, 1500])}
    runs[None] = wheel(300, 20)
    rows = [(g, i, float(v)) for g, x in runs.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, a double").repartition(6)
    got = {r.g: (r.start, r.stop) for r in turning.turning(df, "a", "g", "i").collect()}
    assert got == {g: signal.start_and_stop(x) for g, x in runs.items()}
    assert len({v for v in got.values()}) > 6
    assert turning.turning(df.limit(0), "a", "g", "i").count() == 0


def test_missing_angles_repeat_the_one_before(spark):
    x = wheel(200, 1)
    rows = [("a", i, None if i % 9 == 4 else float("nan") if i % 9 == 5 else float(v)) for i, v in enumerate(x)]
    held, last = [], 0.0
    for *_, v in rows:
        last = last if v is None or v != v else v
        held.append(last)
    got = turning.turning(spark.createDataFrame(rows, "g string, i int, a double"), "a", "g", "i").first()
    assert (got.start, got.stop) == signal.start_and_stop(np.array(held))


def test_one_long_run_goes_to_many_tasks(spark):
    n = 200_000
    angle = F.when(F.col("id") < 50_000, 0.0).when(F.col("id") < 150_000, ((F.col("id") - 50_000) * 3.7) % 360).otherwise((100_000 * 3.7) % 360)
    df = spark.range(n).select(F.lit("one").alias("g"), "id", angle.alias("a"))
    rows = turning.steps(df, "a", ["g"], ["id"])
    assert rows.count() == n and len(rows.inputFiles()) == 4 == rows.select(F.input_file_name().alias("f")).distinct().count()
    got = turning.turning(df, "a", "g", "id").first()
    x = np.concatenate([np.zeros(50_000), (np.arange(100_000) * 3.7) % 360, np.full(50_000, (100_000 * 3.7) % 360)])
    assert (got.start, got.stop) == signal.start_and_stop(x)


@pytest.mark.parametrize("name", ["wheel_turning", "turning_of_long_runs"])
def test_queries(spark, name):
    from spokeflow import catalog

    assert queries.wheel_turning
    oracle.same(catalog.queries()[name](spark, "/root/testdata/sf0.001"), oracle.connection(), catalog.oracle_sql()[name])
