"""Token counts as rollups that are maintained by deltas.

Totals by source, language and tokenizer version are never counted anew. A batch of changes (documents that
come, go, or get another count) becomes signed sums per group; the sums of all committed batches add up to
the totals. A batch is written aside and renamed to its number when it is whole, so it is seen whole or not at all, and a
number that is committed stays as it is: a retry or a replay of it changes nothing and reads nothing, even if it
dies half-way or brings other rows. `compact` folds the batches that stand into a base that says which numbers it holds.

Several writers may commit and compact at once: of two that bring the same number one is told True, and its rows are the ones
that count. That rests on a rename of a folder that either happens or not, as HDFS and local file systems have it; a store without one
needs a single writer.

Defined cases: null source, language or version are groups of their own; a null text has no tokens and
still counts as a document; texts of any length are counted whole; a batch without rows is committed and adds nothing;
repeated rows count each; columns beside the named ones are not read, so they may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.llm.bpe import loaded, small_batches
from spokeflow.plans.lineage import bounded_batches

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of new rows; counts has KEYS, n_tokens and n_bytes."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revisions(counts: DataFrame, old: Column, new: Column) -> DataFrame:
    """Deltas of rows whose token count changes from `old` to `new`."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (new - old).alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes"))


class TokenRollup:
    """Totals kept at a path in storage that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        found = [int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-")]
        return sorted(n for n in found if self._fs.exists(self._at(f"{self.path}/{kind}-{n}/_SUCCESS")))

    def _publish(self, rows: DataFrame, name: str, note: str | None = None) -> bool:
        """Write rows, and a note beside them, aside and rename them to `name`; False if another writer was there first.

        What stands under a name is never deleted but for a folder without content, which no writer publishes. Storage that answers a
        rename onto a folder by moving into it is found out by looking there.
        """
        own = f"_aside-{uuid.uuid4().hex}"
        aside, goal = self._at(f"{self.path}/{own}"), self._at(f"{self.path}/{name}")
        rows.write.parquet(aside.toString())
        if note is not None:
            out = self._fs.create(self._at(f"{self.path}/{own}/_numbers"))
            out.write(bytearray(note.encode()))
            out.close()
        moved = False
        if not self._fs.exists(self._at(f"{self.path}/{name}/_SUCCESS")):
            if self._fs.exists(goal) and not self._fs.listStatus(goal):
                self._fs.delete(goal, False)  # not recursive: fails on a folder that has been filled meanwhile
            moved = self._fs.rename(aside, goal)
            inside = self._at(f"{self.path}/{name}/{own}")
            if self._fs.exists(inside):
                self._fs.delete(inside, True)
                moved = False
        if not moved:
            self._fs.delete(aside, True)
        return moved

    def _state(self) -> tuple[list[str], set[int], int]:
        """The folders whose sums add up to the totals, the numbers they stand for, and the number of the base among them."""
        base = max(self._numbers("base"), default=0)
        folded: set[int] = set()
        if base:
            held = self._fs.open(self._at(f"{self.path}/base-{base}/_numbers"))
            note = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
            held.close()
            for run in note.split(","):
                low, _, high = run.partition("-")
                folded |= set(range(int(low), int(high or low) + 1))
        batches = [n for n in self._numbers("batch") if n not in folded]
        parts = [f"{self.path}/base-{base}"] * bool(base) + [f"{self.path}/batch-{n}" for n in batches]
        return parts, folded | set(batches), base

    def commit(self, number: int, deltas: DataFrame) -> bool:
        """Commit a batch, a number from 0 up; False if that number stands already, alone or in a base, and nothing was done."""
        if number < 0:
            raise ValueError("numbers of batches count from 0")
        if number in self._state()[1]:
            return False
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return self._publish(sums, f"batch-{number}")

    def _summed(self, parts: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        """Groups that still hold something."""
        return self._summed(self._state()[0])

    def compact(self) -> int:
        """Fold the batches that stand now into one base; returns the last number in it, -1 if there is none.

        The base says which numbers it holds, and exactly those were summed: what is committed meanwhile, or comes late with a lower number, is
        counted beside it. Of two compactions at once one is dropped.
        """
        parts, numbers, base = self._state()
        if len(parts) > bool(base):
            self._publish(self._summed(parts), f"base-{base + 1}", _runs(sorted(numbers)))
        return max(numbers, default=-1)


def _runs(numbers: list[int]) -> str:
    """Numbers as runs: 1-4,7."""
    runs: list[list[int]] = []
    for n in numbers:
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return ",".join(f"{a}-{b}" if a < b else f"{a}" for a, b in runs)


def token_counts(docs: DataFrame, tokenizer: str, version: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """`keep`, tokenizer (the version), n_tokens, n_bytes and text_md5 of every document."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for whole in batches:
            for batch in small_batches(whole, whole.num_columns - 1, 16 << 20):
                n = [len(bpe.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text)).alias("text_md5"), text.alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, n_tokens bigint").withColumn("tokenizer", F.lit(version))
