import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spokeflow.llm import bpe, token_rollup

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ForcedBoundaryBPE(f.read()), Tokenizer.from_file(PATH)


def test_every_code_point_splits_alike(both):
    mine, theirs = both
    for lo in range(0, 0x30000, 2048):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} " for c in range(lo, lo + 2048) if not 0xD800 <= c < 0xE000]
        for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
            assert mine.encode(t).tolist() == e.ids, t


def test_random_texts(both):
    mine, theirs = both
    r = random.Random(1)
    parts = list("aA1 \n\t'sé中\x1c😀dre") + ["<|endoftext|>", "  ", "'re", "<|endof"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t).tolist() == ids
        assert mine.decode(np.array(ids, np.int32)) == theirs.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain(both):
    mine, _ = both
    r = random.Random(2)
    for _ in range(300):
        piece = bytes(r.choice(b"abcxyzqj~!@#\xc3\xa9\xe4") for _ in range(r.randint(1, 120)))
        assert b"".join(mine.fragments(piece)) == piece
        joined = [i for f in mine.fragments(piece) for i in mine._merged(f)]
        assert joined == list(mine._merged(piece))


def test_long_texts(both, monkeypatch):
    mine, theirs = both
    text = "word " * 3000 + "x" * 20_000 + " " * 5000 + "end"
    want = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == want
    monkeypatch.setattr(bpe, "LONG", 100)
    assert mine.encode(text).tolist() == want


def test_frame_and_rollup(spark, both, tmp_path):
    _, theirs = both
    rows = [(1, "hello world", "a", "en"), (2, None, "a", None), (3, "", None, "en"), (4, "hello world", "a", "en"), (4, "hello world", "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.encode(df, PATH, decode=True).collect()}
    assert out[1, "hello world"] == theirs.encode("hello world", add_special_tokens=False).ids and out[2, ""] == []
    assert bpe.encode(df.limit(0), PATH).count() == 0
    counts = token_rollup.token_counts(df, PATH, "v1").cache()
    roll = token_rollup.TokenRollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().count() == 0
    roll.commit(1, token_rollup.inserts(counts))
    first = sorted(map(tuple, roll.totals().collect()), key=repr)
    roll.commit(1, token_rollup.inserts(counts))
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == first
    assert ("a", "en", "v1", 3, 6, 33) in first and ("a", None, "v1", 1, 0, 0) in first
    roll.commit(2, token_rollup.deletes(counts.where("doc_id = 1")))
    from pyspark.sql import functions as F

    roll.commit(3, token_rollup.revisions(counts.where("doc_id = 4"), F.col("n_tokens"), F.col("n_tokens") + 5))
    after = sorted(map(tuple, roll.totals().collect()), key=repr)
    assert ("a", "en", "v1", 2, 14, 22) in after
    assert roll.compact() == 3 and sorted(map(tuple, roll.totals().collect()), key=repr) == after
    assert not roll.commit(2, token_rollup.inserts(counts)) and sorted(map(tuple, roll.totals().collect()), key=repr) == after
    (tmp_path / "roll" / "batch-9").mkdir()
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == after
    assert roll.commit(4, token_rollup.inserts(counts.limit(0)))
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == after
    # a copy that broke off is committed anew; what stands stays, whatever a replay brings or does
    assert roll.commit(9, token_rollup.inserts(counts.where("doc_id = 4")))
    more = sorted(map(tuple, roll.totals().collect()), key=repr)
    assert more != after and not roll.commit(9, token_rollup.deletes(counts))
    fails = counts.withColumn("n_tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        roll.commit(10, token_rollup.inserts(fails))
    assert not roll.commit(9, token_rollup.inserts(fails))  # not even read
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == more
    assert roll.commit(10, token_rollup.deletes(counts.where("doc_id = 4"))) and sorted(map(tuple, roll.totals().collect()), key=repr) == after


def delta(spark, n):
    return spark.createDataFrame([("s", "l", "v", n, n, n)], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint")


def docs_in(roll):
    return sum(r.n_docs for r in roll.totals().collect())


def between(roll, act):
    """Does `act` after the writer has looked at what stands and before it publishes."""
    publish = roll._publish

    def late(*args):
        roll._publish = publish
        act()
        return publish(*args)

    roll._publish = late


def test_a_batch_committed_during_a_compaction_counts_once(spark, tmp_path):
    one, two = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/roll") for _ in range(2))
    one.commit(1, delta(spark, 1))
    one.commit(2, delta(spark, 10))
    between(one, lambda: two.commit(3, delta(spark, 100)))
    assert one.compact() == 2 and docs_in(one) == 111
    assert one.compact() == 3 and docs_in(two) == 111 and not two.commit(3, delta(spark, 100))
    between(one, lambda: two.compact())
    assert two.commit(4, delta(spark, 1000)) and one.compact() == 4 and docs_in(one) == 1111


def test_two_writers_of_one_number(spark, tmp_path):
    one, two = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/roll") for _ in range(2))
    told = []
    between(one, lambda: told.append(two.commit(5, delta(spark, 5))))
    assert not one.commit(5, delta(spark, 7)) and told == [True] and docs_in(one) == 5
    # the other publishes between the last look and the rename
    rename = one._fs.rename

    class Late:
        def __getattr__(self, name):
            return getattr(two._fs, name)

        def rename(self, a, b):
            told.append(two.commit(6, delta(spark, 20)))
            return rename(a, b)

    one._fs = Late()
    assert not one.commit(6, delta(spark, 70)) and told == [True, True] and docs_in(two) == 25
    assert not [p for p in (tmp_path / "roll").rglob("_aside-*")]


def test_a_late_number_counts_after_a_compaction(spark, tmp_path):
    roll = token_rollup.TokenRollup(spark, f"file://{tmp_path}/roll")
    assert roll.compact() == -1
    roll.commit(1, delta(spark, 1))
    roll.commit(3, delta(spark, 100))
    assert roll.compact() == 3
    assert roll.commit(2, delta(spark, 10)) and not roll.commit(2, delta(spark, 10)) and not roll.commit(3, delta(spark, 9)) and docs_in(roll) == 111
    assert roll.compact() == 3 and docs_in(roll) == 111 and not roll.commit(2, delta(spark, 10))


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "word " * 900_000, "s", "l", 1, 2, 3), (2, None, None, "l", 1, 2, 3), (2, None, None, "l", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, n_bytes int, ids int")
    counts = token_rollup.token_counts(df, PATH, "v")
    theirs = Tokenizer.from_file(PATH)
    n = len(theirs.encode(rows[0][1], add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes) for r in counts.collect()) == [(1, n, 4_500_000), (2, 0, 0), (2, 0, 0)]
    out = {r.doc_id: r.n_tokens for r in bpe.digests(bpe.encode(df, PATH, decode=True)).collect()}
    assert out == {1: n, 2: 0}


def test_query_against_the_library(spark):
    import hashlib

    from spokeflow.llm import registry
    from tests.oracle import SF

    theirs = Tokenizer.from_file(PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op7_bpe(spark, SF).collect()} == want


def test_rollup_query_adds_up(spark):
    from spokeflow.llm import registry
    from tests.oracle import SF

    totals = registry.op6_token_rollup(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.groupBy("text").agg({"doc_id": "min"}).count()
    assert sum(r.n_docs for r in totals) == kept
    theirs = Tokenizer.from_file(PATH)
    rows = {}
    for r in docs.collect():
        if r.text not in rows or r.doc_id < rows[r.text][0]:
            rows[r.text] = (r.doc_id, r.source, r.lang)
    want = {}
    for t, (_, s, l) in rows.items():
        n, tokens, size = want.get((s, l), (0, 0, 0))
        want[s, l] = n + 1, tokens + len(theirs.encode(t, add_special_tokens=False).ids), size + len(t.encode())
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in totals} == want
