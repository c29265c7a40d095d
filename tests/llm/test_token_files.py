import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeflow.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return token_files.WordEncoder(f.read()), Tokenizer.from_file(PATH)


def test_every_code_point_is_encoded_alike(both):
    mine, theirs = both
    for lo in range(0, 0x30000, 2048):
        texts = [f"A{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} e{chr(c)}́" for c in range(lo, lo + 2048) if not 0xD800 <= c < 0xE000]
        for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
            assert mine.encode(t, 1).tolist() == [*e.ids, 1], ascii(t)


def test_random_texts(both, monkeypatch):
    mine, theirs = both
    r = random.Random(1)
    parts = list("aA1 \n\t'sé中\x1c\x1f\x85 😀dreΣσİ́") + ["<|endoftext|>", "  ", "'RE", "<|endof", "don't", "hello"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert mine.encode(t, 1).tolist() == [*theirs.encode(t, add_special_tokens=False).ids, 1], ascii(t)
    long = "".join(r.choice(parts) for _ in range(20_000))
    want = [*theirs.encode(long, add_special_tokens=False).ids, 7]
    assert mine.encode(long, 7).tolist() == want
    monkeypatch.setattr(token_files, "RUN", 50)
    assert mine.encode(long, 7).tolist() == want


def brute(rows, theirs):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_files_against_the_library(spark, both, tmp_path):
    _, theirs = both
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (-5, "Hello <|endoftext|> World"), (None, "of no id"), (10_002, "many words " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, ids int").repartition(7)
    files = token_files.write_tokens(df, f"{tmp_path}/t", PATH, end=1, files=5, group_bytes=1 << 16, page_rows=10)
    got = [tuple(r) for r in token_files.digests(files.tokens()).orderBy("start").collect()]
    assert got == brute(rows, theirs)
    assert [tuple(r) for r in files.documents().orderBy("start").collect()] == [g[:3] for g in got]
    every = np.concatenate([r.ids for r in files.tokens().orderBy("start").collect()])
    span = files.span(got[3][1] + 2, got[9][1] + 1).orderBy("start").collect()
    assert span[0].start == got[3][1] + 2
    assert np.array_equal(np.concatenate([r.ids for r in span]), every[got[3][1] + 2 : got[9][1] + 1])
    some = files.tokens(F.col("doc_id").isin(3, 10_002))
    assert sorted(r.doc_id for r in some.collect()) == [3, 10_002]
    assert any("PushedFilters" in line and "In(doc_id" in line for line in plan(some).split("\n"))


def test_layout_of_the_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"document number {i} " * 40) for i in range(2000)], "doc_id long, text string")
    files = token_files.write_tokens(df, f"{tmp_path}/t", PATH, end=1, files=2, group_rows=400, page_rows=50)
    ids = []
    for f in sorted((tmp_path / "t").glob("part-*")):
        p = pq.ParquetFile(f)
        ids += p.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert p.metadata.num_row_groups > 1 and p.metadata.row_group(0).num_rows == 400
        for c in range(p.metadata.num_columns):
            at = p.metadata.row_group(0).column(c)
            assert at.has_column_index and at.has_offset_index
            dictionary, delta = "RLE_DICTIONARY" in at.encodings, "DELTA_BINARY_PACKED" in at.encodings
            assert (dictionary, delta) == ((True, False) if "ids" in at.path_in_schema else (False, True))
    assert ids == list(range(2000))
    read = [line for line in plan(files.documents()).split("\n") if line.startswith("ReadSchema")]
    assert read and not any("ids" in line for line in read)


def test_repeated_rows_and_empty_tables(spark, both, tmp_path):
    _, theirs = both
    rows = [(5, "same text")] * 40 + [(5, "another")] * 3 + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    files = token_files.write_tokens(df, f"{tmp_path}/t", PATH, end=1, files=8)
    got = token_files.digests(files.tokens()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 9 + [5] * 43
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(r[2:] for r in brute(rows, theirs))
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    empty = token_files.write_tokens(df.limit(0), f"{tmp_path}/e", PATH, end=1)
    assert token_files.digests(empty.tokens()).count() == 0 and empty.documents().count() == 0
