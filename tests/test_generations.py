"""Of two generations of a sensor's file the newer counts, which is settled among the files."""

from spokeflow.sources import readers


def test_channels_of_files(spark):
    rows = [("d/1/wheel.npy", [0.0, 9.0]), ("d/1/wheel_v3.npy", [0.0, 1.0, 2.0]), ("d/2/wheel.npy", [0.0, 7.0]), ("d/2/wheel_v3.npy", [3.0]),
            ("d/1/cart.npy", [1.0, 2.0, 3.0, 4.0]), ("d/2/cart.npy", [1.0, 2.0]), ("d/1/ati.npy", [5.0, 1.0, 2.0]), ("d/1/other.npy", [1.0, 2.0])]
    out = readers.sensor_stream(spark.createDataFrame(rows, "path string, values array<double>"))
    got = sorted((r.run, r.channel, r.ts, r.value) for r in out.where("value is not null").collect())
    assert got == [("d/1", "current", 1.0, 4.0), ("d/1", "ft_0", 5.0, 1.0), ("d/1", "ft_1", 5.0, 2.0), ("d/1", "rho", 0.0, 2.0), ("d/1", "sink", 1.0, 3.0), ("d/2", "rho", 0.0, 7.0)]
    assert out.where("value is null").count() == 6
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "path#" in joins[0]
