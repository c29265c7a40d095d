import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.sources import sliced


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.i, tuple(r["values"])) for r in df.collect())


@pytest.mark.parametrize("order,dtype,shape", [("C", "<f8", (500, 7)), ("F", "<f4", (500, 7)), ("C", ">i2", (300,)), ("C", "<f8", (0, 3)), ("F", "<i8", (1, 4))])
def test_one_array_file_goes_to_many_tasks(spark, tmp_path, order, dtype, shape):
    x = (np.random.default_rng(1).normal(size=shape) * 100).astype(dtype)
    np.save(tmp_path / "a.npy", np.asarray(x, order=order))
    want = [("a.npy", i, tuple(np.atleast_1d(v).astype(float).tolist())) for i, v in enumerate(x)]
    for size in (64, 1000, 1 << 20):
        df = sliced.read_rows(spark, f"file://{tmp_path}", "npy", ".npy", slice_bytes=size)
        assert rows(df) == want
    if len(x) > 100:
        df = sliced.read_rows(spark, f"file://{tmp_path}/a.npy", "npy", slice_bytes=1000)
        assert df.select(F.spark_partition_id()).distinct().count() > (2 if x.nbytes > 3000 else 0)
    if x.ndim == 2 and len(x):
        some = sliced.read_rows(spark, f"file://{tmp_path}", "npy", columns=[2, 0], slice_bytes=300)
        assert rows(some) == [(p, i, (v[2], v[0])) for p, i, v in want]


def test_point_and_image_files(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.bin").write_bytes(struct.pack("<ii", 10, 3) + x.tobytes())
    (tmp_path / "p" / "two.bin").write_bytes(struct.pack("<ii", 0, 3))
    assert rows(sliced.read_rows(spark, f"file://{tmp_path}/p", "points", slice_bytes=20)) == [("one.bin", i, tuple(v.tolist())) for i, v in enumerate(x)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "images").write_bytes(bytes([0, 0, 8, 3]) + struct.pack(">iii", 5, 2, 2) + bytes(range(20)))
    assert rows(sliced.read_rows(spark, f"file://{tmp_path}/m", "idx", slice_bytes=7)) == [("images", i, tuple(range(4 * i, 4 * i + 4))) for i in range(5)]


def test_chosen_files_alone_are_opened(spark, tmp_path):
    for k in range(4):
        np.save(tmp_path / f"{k}.npy", np.full((3, 2), k))
    (tmp_path / "broken.npy").write_bytes(b"no array")
    paths = [f"file://{tmp_path}/{k}.npy" for k in (1, 3)]
    some = sliced.read_rows(spark, f"file://{tmp_path}", "npy", ".npy", only=paths)
    assert some.where(F.col("path") == paths[0]).count() == 3 and some.count() == 6 and {r.path for r in some.collect()} == set(paths)
    with pytest.raises(Exception, match="array"):
        sliced.read_rows(spark, f"file://{tmp_path}", "npy", ".npy").collect()


def test_objects_are_refused(spark, tmp_path):
    b = io.BytesIO()
    np.save(b, np.array([{}], object), allow_pickle=True)
    (tmp_path / "o.npy").write_bytes(b.getvalue())
    with pytest.raises(Exception, match="only arrays"):
        sliced.read_rows(spark, f"file://{tmp_path}", "npy").collect()


@pytest.mark.parametrize("kind", ["npy", "points", "idx"])
def test_written_files_are_whole_and_readable(spark, tmp_path, kind):
    df = spark.range(1000).select(F.array(*[((F.col("id") + k) % 251).cast("double") for k in range(3)]).alias("values")).repartition(3)
    sliced.write_rows(df, f"file://{tmp_path}/w", kind, rows=90)
    files = sorted((tmp_path / "w").iterdir())
    assert len(files) >= 12 and not [f for f in files if f.name.startswith("_")]
    if kind == "npy":
        assert sum(len(np.load(f)) for f in files) == 1000
    back = sliced.read_rows(spark, f"file://{tmp_path}/w", kind, slice_bytes=100)
    assert sorted(tuple(r["values"]) for r in back.collect()) == sorted(tuple(r["values"]) for r in df.collect())
    sliced.write_rows(df.limit(5), f"file://{tmp_path}/w", kind, mode="overwrite")
    assert sliced.read_rows(spark, f"file://{tmp_path}/w", kind).count() == 5
    failing = df.withColumn("values", F.when(F.rand(1) < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="lost"):
        sliced.write_rows(failing, f"file://{tmp_path}/w", kind)
    assert sliced.read_rows(spark, f"file://{tmp_path}/w", kind).count() == 5
