import hashlib
import random
import tracemalloc

from spokeflow.llm import fill_middle, registry
from tests import oracle


def plain(i, text):
    """(n, form, prefix_chars, middle_chars, output) with a list of units."""
    units = list(text or "")
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not units or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_against_a_list_of_units(spark):
    r = random.Random(3)
    parts = list("ab \n\r\x00é中😀́") + ["<", "P", "S", "M", ">", "<P", "<S", "S>", "\r\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "x<M>y"), (10, "z" * 300_000), (10, "z" * 300_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, output string").repartition(3)
    made = fill_middle.fill_in_middle(df)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(made.output, made.form).alias("back")).collect()
    key = lambda x: repr(x)
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    sql = registry.oracle_sql()["op12_fill_middle"]
    oracle.same(registry.queries()["op12_fill_middle"](spark, oracle.SF), oracle.connection(), sql)


def test_other_units():
    words = fill_middle.UnitMatcher(r"\S+\s*")
    assert words.count("one two  three") == 3 and words.count(" ") == 0
    assert words.ends("one two  three", 0, 2) == (0, 9) and words.ends("one two  three", 1, 3) == (4, 14)


def test_memory_stays_constant():
    matcher, text = fill_middle.UnitMatcher(), "ab" * 1_000_000
    tracemalloc.start()
    assert matcher.count(text) == 2_000_000 and matcher.ends(text, 500_000, 1_999_999) == (500_000, 1_999_999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000
