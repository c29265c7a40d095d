import zlib
from collections import Counter

from spokeflow.llm import sharding


def test_law_and_mixture(spark):
    rows = [(i, "t" * (i % 50) if i % 7 else None, None if i % 97 == 0 else f"s{0 if i % 3 == 0 else i % 9}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sharding.proportional_shards(df, shards=24, buckets=16).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    whole = Counter(r.source for r in out)
    for s in range(24):
        part = Counter(r.source for r in out if r.shard == s)
        assert all(abs(part[k] - whole[k] / 24) <= 2 for k in whole)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in out)
    again = sharding.proportional_shards(df.repartition(7), shards=24, buckets=16).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    other = {r.doc_id: r.shard for r in sharding.proportional_shards(df, shards=24, seed=8, buckets=16).collect()}
    assert sum(other[r.doc_id] != r.shard for r in out) > 2000


def test_small_tables_ties_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.proportional_shards(empty).count() == 0
    rows = [(1, "x", "a", 5)] * 5 + [(None, None, None, 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    out = sharding.proportional_shards(df, shards=24).collect()
    assert len(out) == 8 and all(r.slot == 0 for r in out) and len({r.shard for r in out}) == 8


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    plan = sharding.proportional_shards(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_alike_rows_spread(spark):
    """Null ids with texts of their own don't meet in one piece, and rows that are alike are ranked as one."""
    rows = [(None, f"text {i}", "a") for i in range(1500)] + [(None, None, "a")] * 1200 + [(7, "same", "b")] * 300 + [(i, "x" * 30_000 if i == 5 else "y", "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = sharding.proportional_shards(df, shards=24, buckets=64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in out) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode()), s) for i, t, s in rows)
    n = Counter(r.shard for r in out)
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(n[s])) for s in n)
    whole = Counter(r.source for r in out)
    for s in n:
        part = Counter(r.source for r in out if r.shard == s)
        assert all(abs(part[k] - whole[k] / 24) <= 2 for k in whole)


def test_any_number_of_pieces_gives_one_order(spark):
    rows = [(i % 40 if i % 5 else None, "t" * (i % 3), f"s{i % 4}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    many = [sorted(map(tuple, sharding.proportional_shards(df, shards=7, buckets=b).collect()), key=repr) for b in (1, 3, 64, 4096)]
    assert all(m == many[0] for m in many)


def test_long_texts_and_any_names(spark):
    df = spark.createDataFrame([(1, "é" * 3_000_000, "a", 1, 2, 3, 4), (2, "", "a", 1, 2, 3, 4)], "doc_id long, text string, source string, size int, _h int, _c int, _cut int")
    out = {r.doc_id: r.size for r in sharding.proportional_shards(df).collect()}
    assert out == {1: 6_000_008, 2: 8}
