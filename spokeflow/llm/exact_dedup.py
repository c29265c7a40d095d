"""Exact deduplication by a 128-bit content hash with a byte comparison inside each hash group.

Two texts are equal when they are identical after every run of ASCII white space
(``[\\x20\\x09-\\x0D]+``) has become one space. The hash is the MD5 of the normalised text. Rows are
grouped by (hash, normalised text): the hash places a group, the second key compares the bytes, so a
hash collision leaves two groups. The aggregate combines within each task before the shuffle, so a
group that holds a third of all rows leaves each task as one row.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id loses to any
other and a group of null ids keeps a null `keep_id`; rows that repeat an id and a text all carry
`kept`, and `survivors` returns such a row once; texts of any length are compared whole; an empty table gives no rows. Only
the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    return norm.withColumn("_h", F.unhex(F.md5("_norm")))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct normalised text: its hash, its second digest, keep_id and group_size."""
    groups = (
        _hashed(docs, id_col, text_col)
        .groupBy("_h", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return groups.select("_h", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    classes = _classes(docs, id_col, text_col)
    rows = _hashed(docs, id_col, text_col).select("_id", "_h", F.sha2("_norm", 256).alias("_sha"))
    return rows.join(classes, ["_h", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one of the smallest id.

    Decisions join back on the id; a document's text does not move a second time for them unless ids
    repeat, which a pass over the ids alone finds out. Then of rows of that id and equal texts the one whose columns
    as JSON come first stays. Columns are told by their place, so they may have any names.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    repeated = not rows.groupBy(own).count().where("count > 1").isEmpty()
    if not repeated:
        gone = exact_dedup(rows, own, text).where("not kept").select(F.col(own).alias("gone"))
        return rows.join(gone, rows[own].eqNullSafe(gone["gone"]), "left_anti").toDF(*names)
    # ids that repeat do not name a document, so the text decides along with the id
    keep = _classes(rows, own, text).select("_h", "_sha", "keep_id")
    norm = normalised(F.col(text))
    keyed = rows.select(F.struct(*rows.columns).alias("row"), F.unhex(F.md5(norm)).alias("_h"), F.sha2(norm, 256).alias("_sha"))
    kept = keyed.join(keep, ["_h", "_sha"]).where(F.col(f"row.{own}").eqNullSafe(F.col("keep_id")))
    kept = kept.groupBy("_h", "_sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*").toDF(*names)
