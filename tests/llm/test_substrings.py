import hashlib
from collections import Counter

import numpy as np
import pytest

from spokeflow.llm import registry, substring_dedup
from spokeflow.llm._anchors import long_segments, segments
from spokeflow.llm._bwt import repeated
from tests.oracle import SF


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        m = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                m[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        out[i, len(d), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~m])).hexdigest()] += 1
    return out


def got(df, length, **k):
    return Counter(tuple(r) for r in substring_dedup.digests(substring_dedup.remove_repeats(df, length, **k)).collect())


def test_expansion_against_counting():
    r = np.random.default_rng(1)
    for t in range(300):
        n = int(r.integers(30, 300))
        s = r.integers(0, int(r.integers(2, 6)), n)
        if t % 7 == 0:
            s = np.tile(s[:11], n // 11 + 1)[:n]
        length = int(r.integers(3, 40))
        twice = np.concatenate([s, s]).tolist()
        runs = [tuple(twice[i : i + length]) for i in range(n)]
        count = Counter(runs)
        assert repeated(s.astype(np.int64), length).tolist() == [count[x] > 1 for x in runs]


def test_segments_partition_windows():
    r = np.random.default_rng(2)
    for _ in range(40):
        texts = [bytes(r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(0, 400))).astype(np.uint8)) for _ in range(6)]
        length, k = 30, int(r.integers(2, 29))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        own, covered = {}, Counter()
        for i, first, windows, key, _ in zip(*segments(raw, starts, ends, length, k)):
            for p in range(first, first + windows):
                covered[i, p] += 1
                assert own.setdefault(texts[i][p : p + length], key) == key
        assert covered == Counter({(i, p): 1 for i, x in enumerate(texts) for p in range(len(x) - length + 1)})
        for x in texts:
            if len(x) >= length:
                q = np.frombuffer(x, np.uint8)
                one = segments(q, np.array([0]), np.array([len(x)]), length, k)
                assert all((a == b).all() for a, b in zip(one, long_segments(q, length, k, 37)))


@pytest.mark.parametrize("options", [{}, {"hot": 2, "chunk": 100}, {"hot": 1, "chunk": 1}])
@pytest.mark.parametrize("length", [6, 30])
def test_small_texts(spark, options, length):
    r = np.random.default_rng(0)
    rows = [(int(i) if i % 9 else None, None if i % 13 == 0 else "".join(r.choice(list("abé "), int(r.integers(0, 120))))) for i in range(120)]
    rows += rows[:20] + [(500 + i, "zq" * 200 + str(i)) for i in range(6)] + [(7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, length, **options) == brute(rows, length)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in registry.op2_substrings(spark, SF).collect()) == brute(rows, 200)


def test_cases(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert got(empty, 200) == Counter()
    rows = [(1, "ab" * 3000, 0), (2, "x" * 199, 0), (3, "x" * 200, 0), (4, "y" * 201, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert got(df, 200) == brute([r[:2] for r in rows], 200)
    spans = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in substring_dedup.remove_repeats(df).collect()}
    assert spans == {1: [(0, 6000)], 2: [], 3: [], 4: [(0, 201)]}


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SLICE", 1000)
    r = np.random.default_rng(5)
    big = "".join(r.choice(list("abcdefgh"), 20_000))
    raw, at = np.frombuffer(big.encode(), np.uint8), np.array([0, len(big)])
    assert len(segments(raw, at[:1], at[1:], 200, 64)[0]) == len(long_segments(raw, 200, 64, 1000)[0])


def test_a_text_of_megabytes(spark):
    """A text longer than four slices goes through the overlapping ones."""
    r = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyz \u00e9"
    big = "".join(np.array(list(letters))[r.integers(0, len(letters), 5_000_000)])
    cut = big[1_040_000:1_060_000]  # over the end of a slice
    rows = [(1, big + cut[5000:9000]), (2, "x" * 150 + cut[:1000] + "y"), (3, big[4_999_000:] + "z" * 300), (4, "other " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 200) == brute(rows, 200)


def test_many_spans_and_equal_letters(spark):
    r = np.random.default_rng(9)
    shared = "".join(r.choice(list("abcdefgh"), 260))
    many = "".join(shared + "".join(r.choice(list("ijklmnop"), 30)) for _ in range(3000))
    rows = [(1, many), (2, "q" * 300_000), (None, "q" * 250), (None, None), (5, many[:5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 200) == brute(rows, 200)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_a_passage_with_many_surroundings(spark, hot):
    r = np.random.default_rng(10)
    word = lambda n: "".join(r.choice(list("abcdefgh "), n))
    passage, tail = word(450), word(90)
    rows = [(i, word(int(r.integers(0, 400))) + passage + (tail[: int(r.integers(0, 90))] if i % 3 else "") + word(int(r.integers(0, 400)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, 200, hot=hot) == brute(rows, 200)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab" * 300, 1, 2, 3, 4)], "doc_id long, text string, _id int, key int, seg int, a int")
    assert got(df, 200) == brute([(1, "ab" * 300)], 200)
