import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.functions import arrays, scalars
from spokeflow.functions.windows import gaussian, running


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("i,end,want", [(205, 100, 5), (-5, 95, 90), (0, 96, 0), (96, 96, 0)])
def test_wrap(spark, i, end, want):
    assert one(spark, scalars.wrap(F.lit(i), end)) == want


def test_contact_column_stays_on_the_ring(spark):
    rows = spark.range(0, 3600).select(scalars.contact_column(F.col("id") / 10).alias("c")).collect()
    assert {r.c for r in rows} <= set(range(96))
    assert one(spark, scalars.contact_column(F.lit(0.0))) == 16


def test_signed_lag_range(spark):
    rows = spark.range(0, 96).select(scalars.signed_lag(F.col("id"), F.lit(40)).alias("l")).collect()
    assert min(r.l for r in rows) == -48 and max(r.l for r in rows) == 47


def test_sinkage_is_zero_without_contact(spark):
    assert one(spark, scalars.sinkage(F.lit(0))) == 0
    assert one(spark, scalars.sinkage(F.lit(4))) < 0


def test_stamps(spark):
    assert one(spark, scalars.parse_stamp(F.lit("1970/01/01 00:01:00.250"))) == 60.25
    assert one(spark, scalars.parse_twelve_hour(F.lit("1/1/1970 1:00:00 PM"))) == 13 * 3600
    assert one(spark, scalars.parse_twelve_hour(F.lit("1/1/1970 12:00:00 PM"))) == 12 * 3600
    assert one(spark, scalars.parse_twelve_hour(F.lit("1/1/1970 12:00:00 AM"))) == 0


def test_run_name(spark):
    name = F.lit("x_lab_terrain_flatlvl_vel_1_EISfreqsweep_2_grousers_4_loading_none_material_mmcrse_hydra_0_pretreat_0_date_20190205_rep_01")
    f = scalars.run_fields(name)
    assert one(spark, f["material"]) == "mmcrse" and one(spark, f["date"]) == "20190205" and one(spark, f["rep"]) == "01"
    assert one(spark, scalars.run_fields(F.lit("bad"))["date"]) is None
    with pytest.raises(Exception, match="not a run name"):
        one(spark, scalars.run_fields(F.lit("bad"), strict=True)["date"])


def test_window_guard():
    with pytest.raises(ValueError):
        running(F.col("x"), "mean", ["r"], ["t"], 1, 2)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert df.agg(F.avg(scalars.nan_to_null(F.col("x"))).alias("m")).first().m == 2.0


def test_array_functions(spark):
    x = np.array([1.0, 5.0, 5.0, 2.0, 9.0, 3.0, 3.0, 3.0])
    a = F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, arrays.quantile(a, 0.3)) == pytest.approx(np.quantile(x, 0.3))
    assert one(spark, arrays.variance(a)) == pytest.approx(x.var())
    assert one(spark, arrays.sum_of_changes(a)) == pytest.approx(np.abs(np.diff(x)).sum())
    assert one(spark, arrays.reoccurring_share(a)) == pytest.approx(5 / 8)
    assert one(spark, arrays.longest_strike(a, False)) == 3
    total = sum(one(spark, arrays.energy_ratio(a, i)) for i in range(10))
    assert total == pytest.approx(1.0)


def test_gaussian_reflects(spark):
    x = np.random.default_rng(0).normal(size=30)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "r int, i int, x double")
    got = [r.g for r in df.select("i", gaussian(F.col("x"), 2.0, ["r"], ["i"]).alias("g")).orderBy("i").collect()]
    reach = 8
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 2.0) ** 2)
    padded = np.pad(x, reach, mode="symmetric")
    want = np.convolve(padded, w / w.sum(), mode="valid")
    assert np.allclose(got, want)


def test_phase(spark):
    assert one(spark, scalars.phase(F.lit(0.0), F.lit(1.0))) == pytest.approx(math.pi / 2)
