import random
from collections import Counter

import duckdb
import pytest

from spokeflow.llm import decontaminate as d
from spokeflow.llm import registry
from tests.oracle import SF


def plain(docs, items, overlap=0.8):
    out = set()
    parts = [(i, d.question_and_answer(t)) for i, t in items if len(d.words(t)) >= 5]
    tiny = [(i, d.words(t)) for i, t in items if 0 < len(d.words(t)) < 5]
    for doc, text in docs:
        w = d.words(text)
        out |= {(doc, i) for i, own in tiny if own == w}  # fewer words than a shingle: the whole document
        held = {n: set(zip(*(w[k:] for k in range(n)))) for n in range(1, 6)}
        for i, (q, a) in parts:
            share = lambda p: (lambda s: sum(x in held[len(x)] for x in s) / len(s) if s else 1.0)(d.shingles(p))  # noqa: E731, B023
            if share(q) >= overlap and share(a) >= overlap and w:
                out.add((doc, i))
    return out


def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id) for r in registry.op1_decontaminate(spark, SF).collect()}
    assert got == plain(docs, items) and got


def test_wand_returns_all_at_the_threshold(monkeypatch):
    monkeypatch.setattr(d, "POSTINGS", 4)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 150)))) for i in range(120)]
    ix = d.BM25Index(items)
    for _ in range(200):
        terms = sorted(r.sample(range(len(ix.codes)), r.randint(1, 200)))
        score = Counter()
        for t in terms:
            for e, s in zip(*ix.postings[t]):
                score[e] += s
        for threshold in (0.02, 0.05, 0.2, 0.5):
            found = ix.retrieve(terms, threshold)
            assert set(found) == {e for e, s in score.items() if s >= threshold - 1e-9}


def test_cases(spark):
    item = "Which of these rivers runs through the old town? The second one, as every child there knows well."
    long = " ".join(f"word{i}" for i in range(400)) + ". the answer is of many words too and ends here now"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Unseen"), (5, item), (6, long)], "item_id long, text string")
    noise = " ".join(f"noise{i}" for i in range(3000))
    rows = [(1, None, 0), (2, "", 0), (3, f"{noise} {item.upper()} {noise}", 0), (4, item.split("?")[0] + "?", 0), (5, noise, 0), (6, f"{noise} {long} x", 0), (3, f"{noise} {item.upper()} {noise}", 0), (None, item, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in d.contaminated(df, items).collect())
    assert got == Counter({(3, 1): 2, (3, 5): 2, (6, 6): 1, (None, 1): 1, (None, 5): 1})
    assert sorted(r.doc_id for r in d.clean(df, items).collect()) == [1, 2, 4, 5]
    assert d.contaminated(df.limit(0), items).count() == 0 and d.contaminated(df, items.limit(0)).count() == 0


def test_long_texts_in_runs(monkeypatch):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    ix = d.BM25Index(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    whole = [sorted(ix.search(t, d.THRESHOLD, d.OVERLAP)) for _, t in docs]
    monkeypatch.setattr(d, "LONG", 10)
    monkeypatch.setattr(d, "RUN", 37)
    assert [sorted(ix.search(t, d.THRESHOLD, d.OVERLAP)) for _, t in docs] == whole and any(whole)  # scores too


@pytest.mark.parametrize("size", [200, 1500, 4000])
def test_any_split_of_the_benchmark_scores_alike(spark, monkeypatch, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "Paris")], "item_id long, text string"))
    rows = lambda items: sorted(tuple(r) for r in d.contaminated(docs, items).collect())
    whole = rows(items)
    monkeypatch.setattr(d, "BLOCK_BYTES", size)
    assert rows(items) == whole and whole
    assert rows(items.orderBy("text").repartition(5)) == whole


def test_short_items_and_scripts_without_spaces():
    items = [(1, "Paris"), (2, "It is Rome"), (3, "哪一条河流经这座古城的中心？答案是第二条小河。"), (4, "ประเทศไทยมีกี่จังหวัด และเมืองหลวงคืออะไร")]
    docs = [(1, "I went to Paris last year"), (2, "paris!"), (3, "It is Rome."), (4, "It is Rome now"), (5, "前面的话哪一条河流经这座古城的中心？答案是第二条小河。后面还有很多别的文字"), (6, "别的文字，没有问题，也没有答案"), (7, "xx ประเทศไทยมีกี่จังหวัด และเมืองหลวงคืออะไร yy")]
    ix = d.BM25Index(items)
    got = {(doc, x[0]) for doc, t in docs for x in ix.search(t, d.THRESHOLD, d.OVERLAP)}
    assert got == plain(docs, items) == {(2, 1), (3, 2), (5, 3), (7, 4)}


def test_parts_far_apart():
    r = random.Random(9)
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    noise = lambda n: [f"noise{r.randint(0, 999)}" for _ in range(n)]
    docs = []
    for i, text in items:
        q, a = d.question_and_answer(text)
        docs.append((i, " ".join(q + noise(400) + a)))
        docs.append((-i, " ".join(a[: len(a) // 2 + 4] + noise(300) + q[len(q) // 2 :] + noise(300) + q[: len(q) // 2 + 4] + noise(300) + a[len(a) // 2 :])))
        edited = [x if r.random() > 0.03 else "edited" for x in q + noise(200) + a]
        docs.append((1_000_000 + i, " ".join(edited)))
    ix = d.BM25Index(items)
    got = {(doc, x[0]) for doc, t in docs for x in ix.search(t, d.THRESHOLD, d.OVERLAP)}
    assert got == plain(docs, items) and {(i, i) for i, t in items if d.words(t)} <= got


def test_weight_in_few_shingles():
    """0.8 of the shingles may carry little of the weight; one-word parts share first words with pairs."""
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join(common) + " " + " ".join(f"rare{i}x{k}" for k in range(9)) + f". answer{i} is c{i % 3}") for i in range(30)]
    items += [(100, "c1"), (101, "c1 c2"), (102, "Say it: c3")]
    r = random.Random(2)
    docs = [(i, " ".join(common) + f" {r.randint(0, 9)} answer{i} is c{i % 3}") for i in range(30)] + [(50, "say it c3 c1 c2"), (51, "c1"), (52, "")]
    ix = d.BM25Index(items)
    got = {(doc, x[0]) for doc, t in docs for x in ix.search(t, d.THRESHOLD, d.OVERLAP)}
    assert got == plain(docs, items) and {(i, i) for i in range(30)} <= got
