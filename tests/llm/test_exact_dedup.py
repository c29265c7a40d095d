import hashlib
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spokeflow.llm import exact_dedup, registry
from tests.oracle import SF, connection, same


def brute(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=repr)


def test_cases(spark):
    rows = [(3, "a  b"), (1, "a\t\nb"), (2, "a b "), (5, None), (4, ""), (None, "x"), (None, "x"), (7, "x"), (7, "x"), (8, "é b"), (9, "é b"), (10, "y " * 50_000), (11, "y\n" * 50_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.text("ab \t\x0b\x1cé", max_size=5)), max_size=12))
def test_any_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_survivors_and_clashing_columns(spark):
    rows = [(1, "a b", 9, "p"), (2, "a  b", 9, "q"), (1, "a b", 9, "p"), (3, None, 9, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id int, _h string")
    kept = exact_dedup.survivors(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    once = exact_dedup.survivors(df.where("_h <> 'p'"))
    assert sorted(r.doc_id for r in once.collect()) == [2, 3]


def test_sql(spark):
    con = connection()
    for name in ("op5_exact_dedup", "op3_sharding"):
        same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


def test_survivors_keep_user_columns(spark):
    names = "doc_id long, text string, __h string, __sha string, __keep int, _h string, keep_id int, `a.b` string, kept boolean, c0 int, row int"
    one = lambda i, t, tag: (i, t, f"h{tag}", f"s{tag}", tag, "x", tag, f"d{tag}", True, tag, tag)
    rows = [one(1, "a b", 2), one(1, "a b", 1), one(2, "a  b", 3), one(3, None, 4), one(None, "n", 5)]
    once = exact_dedup.survivors(spark.createDataFrame(rows[1:], names))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)
    for part in (rows, rows[::-1]):  # the same row whatever the order
        kept = exact_dedup.survivors(spark.createDataFrame(part, names).repartition(3))
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr) and kept.columns[0] == "doc_id"
    assert exact_dedup.survivors(spark.createDataFrame([], names)).count() == 0
