"""Benchmark decontamination: BM25 over test items, answered with block-max WAND.

The question and the answer of a test item are one entry each, indexed by word pairs (one of a single word: by
that word). The question is an item's text up to its last sentence, the answer the rest; a single sentence is halved.
Impacts are BM25 weights divided by the entry's score against itself. Postings of a term are sorted by entry and kept
in blocks with the block's largest impact.

An item is held if the whole document has `overlap` of the five-word shingles of its question, and of its answer,
wherever they stand. So the query is the document's terms, and an entry must reach `threshold` or, if that is less, the
score that `overlap` of its shingles assures: impacts of such entries are raised in that proportion. Pairs that are in
no run of pairs as long as a shingle can't be part of one and are left out, but for those of shorter entries. A
document whose terms' largest impacts don't add up to the threshold is passed over; the others go through block-max
WAND, which returns all entries at or above the threshold. Items with all their entries retrieved are verified.

The index goes to every worker, so a benchmark is taken in blocks of at most BLOCK_BYTES of text, one pass over the
documents each. What weighs terms (entries, their mean length, entries that hold a term) is counted over the whole benchmark
first, and each entry is scored by itself, so rows and scores don't depend on the blocks or on the order of the items.

Words are runs of letters and digits; in scripts that are written without spaces each character is one. An item of fewer
words than a shingle says too little to be found inside other text: a document holds it if it has those words and no others.

Defined cases: null or empty texts match nothing; an item without words matches nothing; items with
the same text are each reported; repeated documents are reported each; scores at the threshold count; texts of any length
are taken whole (long ones in runs of words that overlap by a shingle, which finds the same); empty tables give no rows.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import small_batches
from spokeflow.plans.lineage import bounded_batches, written

THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
POSTINGS = 32  # in a block
BLOCK_BYTES = 8 << 20
LONG = 4 << 20  # characters from which a text is taken in runs of words
RUN = 200_000
K1, B = 1.2, 0.75
# Blocks of scripts without spaces between words (Thai to Myanmar, Khmer, kana and ideographs).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    cuts = [m.end() for m in re.finditer(r"[.?!:](?=\s+\S)|[。？！：](?=\s*\S)", text.strip())]
    for at in reversed(cuts):
        q, a = words(text.strip()[:at]), words(text.strip()[at:])
        if q and a:
            return q, a
    w = words(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def shingles(w: list, size: int = SHINGLE) -> set[tuple]:
    """All runs of `size` words; of fewer words the one whole run, of none nothing."""
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def terms_of(w: list[str]) -> list[str]:
    """The terms of an entry: word pairs, or its one word."""
    return [f"{a} {b}" for a, b in zip(w, w[1:])] if len(w) > 1 else list(w)


@dataclass
class Statistics:
    """What term weights are taken from: entries, their mean number of terms, and entries that hold a term."""

    entries: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, texts: Iterable[str]) -> Statistics:
        counts = [Counter(terms_of(w)) for t in texts for w in question_and_answer(t) if w]
        return cls(len(counts), sum(map(Counter.total, counts)) / max(1, len(counts)), Counter(t for c in counts for t in c))


class BM25Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: Statistics | None = None):
        """An index of items; `whole` are the statistics of the benchmark that they are a part of."""
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        whole = whole or Statistics.of(t for _, t in items)
        self.items, self.parts, entries, spelt = [], [], [], []
        self.tiny: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            all_words = words(text)
            if not all_words:
                continue
            if len(all_words) < SHINGLE:
                self.tiny.setdefault(tuple(all_words), []).append(item)
                continue
            both = question_and_answer(text)
            q, a = ([number(x) for x in part] for part in both)
            self.items.append(item)
            self.parts.append((shingles(q), shingles(a)))
            entries += [(len(self.items) - 1, part) for part in (q, a) if part]
            spelt += [terms_of(part) for part in both if part]
        self.of = [i for i, _ in entries]
        n = max(1, len(self.vocabulary))
        counts = [Counter(self._codes(w, n)) for _, w in entries]
        idf: dict[int, float] = {}
        for (_, w), names in zip(entries, spelt):
            for t, name in zip(self._codes(w, n), names):
                d = whole.df[name]
                idf[t] = math.log(1 + (whole.entries - d + 0.5) / (d + 0.5))
        self.codes = np.array(sorted(idf), np.int64)
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in idf]
        place = {t: i for i, t in enumerate(self.codes.tolist())}
        self.short = np.zeros(len(idf), bool)  # terms of entries of less than a shingle
        self.raised: list[float] = []
        for e, c in enumerate(counts):
            norm = K1 * (1 - B + B * c.total() / whole.mean)
            weight = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            total = math.fsum(weight.values())
            sure = self._assured(entries[e][1], weight, n, overlap) / total
            self.raised.append(max(1.0, threshold / sure))
            for t, x in weight.items():
                ids, impacts = self.postings[place[t]]
                ids.append(e)
                impacts.append(x / total * self.raised[e])
                self.short[place[t]] |= len(entries[e][1]) < SHINGLE
        self.most = np.array([max(x) for _, x in self.postings], float)
        self.blocks = [[max(x[i : i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for _, x in self.postings]

    @staticmethod
    def _codes(w: list[int], n: int) -> list[int]:
        return [a * n + b for a, b in zip(w, w[1:])] if len(w) > 1 else [-1 - x for x in w]

    @classmethod
    def _assured(cls, w: list[int], weight: dict[int, float], n: int, overlap: float) -> float:
        """The least weight of the terms in any `overlap` of the entry's shingles.

        A term is missed only with all its shingles, so each of these carries its part of the weight, and no choice
        of missing shingles misses more than the heaviest of them carry."""
        runs = [set(cls._codes(list(x), n)) for x in shingles(w)]
        shared = Counter(t for x in runs for t in x)
        loads = [sum(weight[t] / shared[t] for t in x) for x in runs]
        missing = len(loads) - max(1, math.ceil(overlap * len(loads) - 1e-9))
        return math.fsum(loads) - math.fsum(nlargest(missing, loads))

    def terms(self, w: np.ndarray) -> np.ndarray:
        """The terms of a run of words that can be part of a held shingle."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        n = len(self.vocabulary)
        pairs = np.full(len(w), -1, np.int64)
        both = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        pairs[both] = self._places(w[both] * n + w[both + 1])
        found, reach = pairs >= 0, SHINGLE - 1
        whole = np.convolve(found, np.ones(reach, np.int64))[reach - 1 : len(found)] == reach  # starts of runs of pairs
        near = np.convolve(whole, np.ones(reach, np.int64))[: len(found)] > 0 if whole.size else np.zeros(len(found), bool)
        pairs = pairs[found & (near | self.short[pairs])]
        single = self._places(-1 - np.unique(w[w >= 0])) if self.codes[0] < 0 else pairs[:0]
        return np.unique(np.concatenate([pairs, single[single >= 0]]))

    def _places(self, code: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[i] == code, i, -1)

    def retrieve(self, terms: list[int], threshold: float) -> dict[int, float]:
        """All entries whose score for a passage reaches the threshold, by block-max WAND."""
        lists = [[self.postings[t][0][0], 0, t] for t in terms]  # entry under the cursor, cursor, term
        out: dict[int, float] = {}
        end = len(self.of)
        low = threshold - 1e-9

        def seek(x: list, entry: int) -> None:
            ids = self.postings[x[2]][0]
            x[1] = bisect_left(ids, entry, x[1])
            x[0] = ids[x[1]] if x[1] < len(ids) else end

        while lists:
            lists.sort(key=lambda x: x[0])
            while lists and lists[-1][0] >= end:
                lists.pop()
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += self.most[x[2]]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == entry:
                pivot += 1
            bound, upto = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for x in lists[: pivot + 1]:  # the blocks that would hold the entry
                ids = self.postings[x[2]][0]
                block = bisect_left(ids, entry, x[1]) // POSTINGS
                if block < len(self.blocks[x[2]]):
                    bound += self.blocks[x[2]][block]
                    upto = min(upto, ids[min((block + 1) * POSTINGS, len(ids)) - 1] + 1)
            if bound < low:  # no entry before `upto` can reach the threshold
                for x in lists[: pivot + 1]:
                    seek(x, max(upto, entry + 1))
                continue
            if lists[0][0] == entry:
                score = math.fsum(self.postings[x[2]][1][x[1]] for x in lists[: pivot + 1])
                if score >= low:
                    out[entry] = score
                for x in lists[: pivot + 1]:
                    seek(x, entry + 1)
            else:
                for x in lists[:pivot]:
                    if x[0] < entry:
                        seek(x, entry)
        return out

    def _runs(self, text: str) -> Iterator[np.ndarray]:
        """Word numbers of a text; of a long one a run at a time, each with the end of the one before."""
        get = self.vocabulary.get
        if len(text) < LONG:
            w = words(text)
            yield np.fromiter((get(x, -1) for x in w), np.int64, len(w))
            return
        found = (get(m.group(), -1) for m in _WORD.finditer(text.lower()))
        tail: list[int] = []
        while run := list(islice(found, RUN)):
            yield np.array(tail + run, np.int64)
            tail = (tail + run)[-SHINGLE:]

    def _retrieved(self, text: str, threshold: float) -> dict[int, float]:
        """Items with all their entries retrieved for the whole document, with the best entry's score."""
        own = [self.terms(ids) for ids in self._runs(text) if len(ids)]
        terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        if not terms.size or self.most[terms].sum() < threshold - 1e-9:
            return {}
        best: dict[int, float] = {}
        met: Counter[int] = Counter()
        for entry, score in self.retrieve(terms.tolist(), threshold).items():
            item = self.of[entry]
            met[item] += 1
            best[item] = max(best.get(item, 0.0), score / self.raised[entry])
        return {i: score for i, score in best.items() if met[i] == sum(map(bool, self.parts[i]))}

    def search(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of every item that a document holds."""
        if not text:
            return []
        small = []
        if self.tiny:
            first = [m.group() for m in islice(_WORD.finditer(text.lower()), SHINGLE)]
            small = [(i, 1.0, 1.0, 1.0) for i in self.tiny.get(tuple(first), ())]
        best = self._retrieved(text, threshold) if self.of else {}
        if not best:
            return small
        sizes = {len(s) for i in best for part in self.parts[i] for s in part}
        met: dict[int, tuple[set, set]] = {i: (set(), set()) for i in best}
        for ids in self._runs(text):
            run = ids.tolist()
            held = {size: set(zip(*(run[i:] for i in range(size)))) for size in sizes}
            for i, found in met.items():
                for part, own in zip(self.parts[i], found):
                    own.update(s for s in part if s in held[len(s)])
        share = lambda i, k: len(met[i][k]) / len(self.parts[i][k]) if self.parts[i][k] else 1.0
        out = [(self.items[i], score, share(i, 0), share(i, 1)) for i, score in best.items()]
        return small + [x for x in out if x[2] >= overlap and x[3] >= overlap]


def _whole_statistics(benchmark: DataFrame, text_col: str) -> tuple[int, float, DataFrame]:
    """Entries, their mean number of terms, and the written table (term, df) of a benchmark of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(terms_of(w)) for t in batch.column(0).to_pylist() for w in question_and_answer(t) if w]
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([c.total() for c in own], pa.int64())], names=["terms", "n"])

    texts = benchmark.where(F.length(text_col) > 0).select(F.col(text_col).alias("_text"))
    entries = written(texts.mapInArrow(run, "terms array<string>, n bigint"))
    total = entries.agg(F.count("*").alias("entries"), F.sum("n").alias("n")).first()
    df = written(entries.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    return total.entries, (total.n or 0) / max(1, total.entries), df


def _statistics_for(items: list[tuple[int, str]], whole: tuple[int, float, DataFrame]) -> Statistics:
    """The whole benchmark's statistics for the terms of one block, which bounds what is fetched."""
    entries, mean, df = whole
    own = sorted({t for _, text in items for w in question_and_answer(text) for t in terms_of(w)})
    spark = df.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": pa.array(own, pa.string())}))
    return Statistics(entries, mean, {r.term: r.df for r in df.join(wanted, "term").toLocalIterator()})


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, as many at a time as hold BLOCK_BYTES; the driver holds no more than that."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col), F.coalesce(F.col(text_col), F.lit(""))).where(F.col(item_col).isNotNull())
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text.encode()) + 64
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and test item that it holds: id, item_id, score, question_overlap, answer_overlap."""
    bounded_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type, item_type = pa_type(docs, id_col), pa_type(benchmark, item_col)
    found, whole = None, None
    blocks = _blocks(benchmark, item_col, item_text)
    ahead = next(blocks, None)
    while ahead is not None:
        items, ahead = ahead, next(blocks, None)
        if whole is None and ahead is not None:  # more than one block
            whole = _whole_statistics(benchmark.where(F.col(item_col).isNotNull()), item_text)
        index = docs.sparkSession.sparkContext.broadcast(BM25Index(items, threshold, overlap, whole and _statistics_for(items, whole)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in small_batches(whole, 1, 16 << 20):
                    ids, out = batch.column(0).to_pylist(), []
                    for i, text in zip(ids, batch.column(1).to_pylist()):
                        out += [(i, *x) for x in index.value.search(text, threshold, overlap)]
                    if out:
                        c = list(zip(*out))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c[0], id_type), pa.array(c[1], item_type), *(pa.array(x, pa.float64()) for x in c[2:])],
                            names=["_id", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("_id", id_col)


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no test item, with all their columns.

    Ids may repeat with other texts: a document is told by its id and text. Columns are told by their place, so they may have any names.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    keyed = rows.select(F.struct(own.alias("id"), digest.alias("md5")).alias("key"), text.alias("text"))
    gone = contaminated(keyed, benchmark, id_col="key", text_col="text", **options)
    gone = gone.select(F.col("key.id").alias("gone"), F.col("key.md5").alias("md5")).distinct()
    return rows.join(gone, own.eqNullSafe(F.col("gone")) & (digest == F.col("md5")), "left_anti").toDF(*names)
