import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from spokeflow.llm import exact_dedup, quality
from tests.llm.test_decontaminate import plain
from tests.llm.test_exact_dedup import brute
from tests.llm.test_simhash import components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    read = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality classifier"](spark, docs, SF).cache()
    assert one.columns == columns
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in read(one)}
    good = [i for i, l in labels.items() if l == (1, 0)]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    bad = [i for i, l in labels.items() if l != (1, 0)]
    assert sum(i in kept for i in bad) <= 0.15 * len(bad)  # 400 labels teach few rare words
    two = stage["exact dedup"](spark, one, SF).cache()
    assert two.columns == columns and sorted(i for i, _ in read(two)) == sorted(r[0] for r in brute(read(one)) if r[3])
    three = stage["SimHash near-dedup"](spark, two, SF).cache()
    want = components([(i, plain_fingerprint(t)) for i, t in read(two)])
    assert three.columns == columns and sorted(i for i, _ in read(three)) == sorted(i for i, _, c in want if i == c)
    four = stage["benchmark decontamination"](spark, three, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i, _ in plain(read(three), items)}
    assert four.columns == columns and sorted(i for i, _ in read(four)) == sorted(i for i, _ in read(three) if i not in gone)
    five = {r.doc_id: list(r.ids) for r in stage["BPE encoding and decoding"](spark, four, SF).collect()}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert five == {i: theirs.encode(t, add_special_tokens=False).ids for i, t in read(four)}


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_ids_lose_no_other_text(spark):
    """Copies and leaks go, and what shares an id with them stays; columns may have the names that stages use inside."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    prose = ["the harbour was quiet that morning and the boats lay still upon the grey water", "a long report on the storage of grain in dry and cold rooms over many winters",
             "nobody had expected the train to be on time yet there it stood at the platform"]
    long = [" ".join(f"{p} {i} {j}" for j in range(6)) for i, p in enumerate(prose)]
    rows = [(1, long[0]), (0, long[0] + " end"), (1, long[1]), (2, long[0]), (2, f"Before it. {item} After it."), (2, long[2]), (None, long[2] + " x"), (None, item)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone int, md5 int, key int")
    stage = dict(corpus_pipeline.STAGES)
    two = stage["exact dedup"](spark, df, SF)
    assert two.columns == df.columns and {(r.doc_id, r.text) for r in two.collect()} == set(rows) - {(2, long[0])}
    three = stage["SimHash near-dedup"](spark, two, SF)
    near = {(r.doc_id, r.text) for r in three.collect()}
    ranked = sorted(set(rows) - {(2, long[0])}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest()))
    want = components([(k, plain_fingerprint(t)) for k, (_, t) in enumerate(ranked)])
    assert near == {ranked[k] for k, _, c in want if k == c} and len(near) < len(ranked)
    four = stage["benchmark decontamination"](spark, df, SF)
    assert four.columns == df.columns and sorted(((r.doc_id, r.text) for r in four.collect()), key=repr) == sorted((x for x in rows if item not in x[1]), key=repr)


def test_classifier_sees_no_more_than_its_sample(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.fit(docs, labels, sample=0).weights == []
    assert exact_dedup.survivors(docs).count() < docs.count()
