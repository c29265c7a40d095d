"""Token ids as Parquet list columns.

A row holds a document: part (the number of its file), place (the ids of its file that stand before it), doc_id, n_tokens
and ids. Files stand in ascending order of ids of documents, and so do the rows of each. Ids of tokens are dictionary
encoded, 16 bits each for a vocabulary of 50,000; part, place, doc_id and n_tokens are delta encoded. Row groups have
a set size and pages carry an index of their values, so documents are found without reading the tokens of others, and
lengths and places without reading any.

Where a document starts among all tokens is the sum of the files before its own, which has a row a file, and its place. So
tokens are written once, in one pass behind one shuffle of the texts.

Texts are encoded by white space: no token, no normalisation and no special token reaches across it, so the ids of a
text are those of its words one after the other, and a text of any length needs the memory of its ids. Words recur, so
their ids are remembered, up to a fixed number; the library's model encodes those that are new, and the whole library
stretches that hold marks, unassigned code points or special tokens.

Defined cases: a null text counts as empty and holds the end id alone; null ids of documents come first; equal ids are
ordered by a hash of the text, and rows that are equal in both are interchangeable and may be dealt to several files;
special tokens written in a text are special tokens, as the library has it; an empty table gives files without
rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeflow.llm.bpe import _lists, byte_alphabet, small_batches
from spokeflow.plans.lineage import bounded_batches

REMEMBERED = 900_000  # chunks, and as many words, that a worker remembers
RUN = 1 << 16  # chunks that are taken at once
GROUP = 32 << 20  # bytes of a row group, as the writer holds them
GROUP_ROWS = 100_000
PAGE_ROWS = 2_000
WHITE = regex.compile(r"[^\S\x1c-\x1f]+")  # str.split() would also split at these four separators
_SEPARATOR = regex.compile(r"[\x1c-\x1f]")


def _doubtful() -> regex.Pattern:
    """Marks and unassigned code points, which versions of Unicode see in different ways."""
    kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
    runs = [(k, len(list(g))) for k, g in groupby("x" if k == "Cn" or k[0] == "M" else "" for k in kinds)]
    ends = np.cumsum([n for _, n in runs]).tolist()
    return regex.compile("[" + "".join(f"\\U{e - n:08x}-\\U{e - 1:08x}" for (k, n), e in zip(runs, ends) if k) + "]")


class _Known(dict):
    """Values of up to `most` keys, the first that come. Others are made anew each time; after `most` of those all are forgotten,
    so that the keys of other texts get their turn."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.passed = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            if len(key) <= 64:
                self[key] = value
            return value
        self.passed += 1
        if self.passed == self.most:
            self.passed = 0
            self.clear()
        return value


class WordEncoder:
    """Ids of texts for a word-level BPE file of the tokenizers library that lower-cases and drops white space.

    What is remembered are the bytes of ids, so those of a text are joined without an object for each.
    """

    def __init__(self, spec: str):
        self._whole = Tokenizer.from_str(spec)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._model = self._whole.model
        j = json.loads(spec)
        specials = [t["content"] for t in j.get("added_tokens", [])]
        self._special = os.path.commonprefix(specials) if specials else None
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self._doubtful = _doubtful().search
        self._usual = {c for c in map(chr, range(0x80, 0x2000)) if not self._doubtful(c)} | set(map(chr, range(0x80)))
        self._stand_in = {b: c for c, b in byte_alphabet().items()}
        self._word = _Known(self._tokenized, REMEMBERED)
        self._chunk = _Known(self._cut, REMEMBERED)

    def _tokenized(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # those stand for themselves
            word = word.encode().decode("latin-1").translate(self._stand_in)
        return array("i", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _cut(self, chunk: str) -> bytes:
        """Ids of a stretch without white space."""
        plain = chunk.isascii()
        if self._special is not None and self._special in chunk or not (plain or self._usual.issuperset(chunk) or not self._doubtful(chunk)):
            return array("i", self._whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        if not plain:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # str.lower() would mind where a sigma stands
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._word[chunk]
        return b"".join(map(self._word.__getitem__, self._words(chunk)))

    def encode(self, text: str, end: int) -> np.ndarray:
        """Ids of a text and then `end`."""
        last = array("i", [end]).tobytes()
        if len(text) < 8 * RUN:
            chunks = WHITE.split(text) if _SEPARATOR.search(text) else text.split()
            return np.frombuffer(b"".join(chain(map(self._chunk.__getitem__, chunks), (last,))), np.int32)
        found = (m.group() for m in regex.finditer(r"(?:\S|[\x1c-\x1f])+", text))
        parts = []
        while run := list(islice(found, RUN)):
            parts.append(b"".join(map(self._chunk.__getitem__, run)))
        return np.frombuffer(b"".join([*parts, last]), np.int32)


_loaded: dict[int, WordEncoder] = {}


def loaded(spec: str) -> WordEncoder:
    """The encoder of a file's content; a worker builds it once."""
    key = hash(spec)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        _loaded[key] = WordEncoder(spec)
    return _loaded[key]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, group_bytes: int = GROUP, group_rows: int = GROUP_ROWS, page_rows: int = PAGE_ROWS,
) -> TokenFiles:
    """Encode all texts and write their ids, each text followed by `end`, in ascending order of `id_col`."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = loaded(spec.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in small_batches(whole, 1):
                ids = [encoder.encode(t, end) for t in batch.column(1).to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                out = [pa.array(np.full(len(ids), part, np.int32)), pa.array(places), batch.column(0), pa.array(n), _lists(ids)]
                yield pa.RecordBatch.from_arrays(out, names=["part", "place", "_id", "n_tokens", "ids"])

    bounded_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.spark_partition_id().alias("_from"))
    order = ["_id", "_hash", "_from"]
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("_id", "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(run, f"part int, place bigint, _id {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("_id", id_col)
    writer = made.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", group_rows)
    writer = writer.option("parquet.page.row.count.limit", page_rows)
    for c in ("part", "place", id_col, "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(path)
    return TokenFiles(spark, path, id_col)


class TokenFiles:
    """Reads what `write_tokens` wrote."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id"):
        self.spark, self.path, self.id_col = spark, path, id_col

    def _rows(self) -> DataFrame:
        """All columns, with start. The files' sums have a row a file and so go to every task."""
        rows = self.spark.read.parquet(self.path)
        sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
        each = sorted(sums.collect(), key=lambda r: r.part)  # a row a file
        ends = np.cumsum([0, *(r._n for r in each)]).tolist()
        bases = self.spark.createDataFrame([(r.part, b) for r, b in zip(each, ends)], "_part int, _base bigint")
        out = rows.join(F.broadcast(bases), F.col("part") == F.col("_part"))
        return out.withColumn("start", F.col("_base") + F.col("place")).drop("_part", "_base")

    def documents(self) -> DataFrame:
        """id, start and n_tokens of every document; no token is read."""
        return self._rows().select(self.id_col, "start", "n_tokens")

    def tokens(self, which: Column | None = None) -> DataFrame:
        """id, start, n_tokens (counted from the ids) and ids; `which` is a condition on the id column, which skips pages and row groups."""
        rows = self._rows() if which is None else self._rows().where(which)
        return rows.select(self.id_col, "start", F.size("ids").cast("long").alias("n_tokens"), "ids")

    def span(self, first: int, stop: int) -> DataFrame:
        """Tokens `first` up to `stop` of all: the documents that hold some, with start (of the first one given) and ids cut to the span."""
        rows = self._rows().where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first))
        low = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
        high = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")).cast("int")
        return rows.select(self.id_col, (F.col("start") + low).alias("start"), F.slice("ids", low + 1, high - low).alias("ids"))


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and the CRC-32 of the ids as little-endian numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["_id", "start", "n_tokens", "ids_crc32"])

    bounded_batches(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("_id"), "start", "n_tokens", "ids")
    return rows.mapInArrow(run, f"_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("_id", id_col)
