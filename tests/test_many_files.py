"""Many small files are written, listed and read by tasks."""

import pytest
from pyspark.sql import functions as F

from spokeflow.queries import tables
from spokeflow.sources import readers, writers


def test_texts_are_listed_and_read_as_by_the_reader_of_spark(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    names = spark.range(300).select(F.format_string("b=%d/r=%d/f.txt", F.col("id") % 7, "id").alias("name"), F.col("id").cast("string").alias("value"))
    writers.write_texts(names, root)
    (tmp_path / "in" / "_hidden.txt").write_text("x")
    (tmp_path / "in" / "other.csv").write_text("x")
    (tmp_path / "in" / "empty").mkdir()
    found = readers.listed(spark, root, "*.txt")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    rows = lambda df: sorted((r.path, bytes(r.content)) for r in df.select("path", "content").collect())
    assert rows(readers.contents(found)) == rows(want) and len(rows(want)) == 300
    assert readers.listed(spark, root, "*.none").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.listed(spark, f"file://{tmp_path}/missing")


def test_events_of_no_user_have_a_file(spark):
    e = spark.createDataFrame([(1, None, 2.0, 3.0), (2, 5, 1.0, 4.0), (3, 5, 1.5, 6.0)], "event_id long, user_id long, value double, t double")
    got = {r.user_id: (r.n, r.re, r.im, r.f) for r in tables._impedance(spark, e).collect()}
    assert got == {None: (1, 2.0, 1.0, 3.0), 5: (2, 2.5, 5.0, 6.0)}
