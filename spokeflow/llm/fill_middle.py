"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is cut into units by a pattern that is matched from left to right. The first pass counts the matches;
the second walks the same lazy iterator only as far as the two ranks where the middle begins and ends. Neither keeps
its matches: whatever the length of a text, a matcher holds one match and two offsets beside it.

The two ranks, the form and its order come from the SHA-256 of `seed:id`, so a row gives the same result in
every run, in any partitioning and after any retry. The text is rebuilt from the output and its form in the JVM.

Defined cases: a null text counts as empty; an empty text and one that holds a sentinel stay plain; a null id hashes
like an empty one; units may be empty of matches (n = 0), and then all text is suffix; text before the first
match goes with the first unit and text between two matches with the later one; a text of any length is
read whole; repeated rows give a row each; an empty table gives no rows. Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import small_batches
from spokeflow.plans.lineage import bounded_batches

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class UnitMatcher:
    """Units of a text as the matches of a pattern; no list of them is made."""

    def __init__(self, pattern: str = CODE_POINT):
        self._matches = re.compile(pattern).finditer

    def count(self, text: str) -> int:
        """First pass: how many units the text has."""
        seen = count()
        deque(zip(self._matches(text), seen), maxlen=0)
        return next(seen)

    def ends(self, text: str, first: int, second: int) -> tuple[int, int]:
        """Second pass: where unit number `first` and unit number `second` end, counted from 1; unit 0 ends where the text begins."""
        matches = self._matches(text)
        a = next(islice(matches, first - 1, None)).end() if first else 0
        ahead = second - first
        b = next(islice(matches, ahead - 1, None)).end() if ahead else a
        return a, b


def _drawn(seed: int, identity: Column) -> list[Column]:
    """Four numbers of 32 bits from the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20, unit: str = CODE_POINT,
) -> DataFrame:
    """id, n (units), form (`psm`, `spm` or `plain`), prefix_chars, middle_chars (code points; null if plain) and output.

    `rate` of 100 texts are rearranged, of which `spm_rate` of 100 put the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = UnitMatcher(unit)
        for whole in batches:
            for batch in small_batches(whole, 1):
                out: list[list] = [[], [], [], [], []]
                for text, *h in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    n = matcher.count(text)
                    form, prefix, middle, made = "plain", None, None, text
                    if text and not (PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate):
                        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                        a, b = matcher.ends(text, low, high)
                        prefix, middle = a, b - a
                        form = "spm" if h[3] % 100 < spm_rate else "psm"
                        head = (SUFFIX, text[b:], PREFIX, text[:a]) if form == "spm" else (PREFIX, text[:a], SUFFIX, text[b:])
                        made = "".join((*head, MIDDLE, text[a:b]))
                    for into, value in zip(out, (n, form, prefix, middle, made)):
                        into.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    drawn = [h.alias(f"_h{i}") for i, h in enumerate(_drawn(seed, F.col(id_col)))]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *drawn)
    made = rows.mapInArrow(run, f"_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts stand between sentinels, which no part holds."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`fill_in_middle` with output_sha256 and restored_sha256 instead of the output."""
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)
