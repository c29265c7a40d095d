"""Proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within their source and ranked there; rank r of n gets the
fractional rank (2r - 1) / 2n; the order by fractional rank interleaves all sources in proportion, and
equal cuts of that order give shards whose mixture matches the whole to within one row per source.

Law: `rows` - row counts of shards differ by one at most. Groups of equal texts are not kept together:
rows are placed one by one, which is what lets a group of any size be spread.

Neither ranking sorts a source or the whole table in one task. The hash space of each source, and then
the range of fractional ranks, is cut into `buckets` equal pieces; the rows before a piece are known
from a histogram, and only the rows of a piece are sorted together. Text is read once and not shuffled. Rows that are
equal in all that a row's place hangs on (id, source, size, checksum) are interchangeable: they are counted before
the shuffle, ranked as one, and take their places again only within the pieces of fractional rank that they fall in.

Defined cases: a null text has no bytes; a null source is a stratum of its own; a null id hashes like an
empty one, beside the size and checksum of its text; texts of any length are read whole; rows that tie in every column used
are interchangeable; an empty table gives no rows. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 8  # bytes that a row takes beside its text


def proportional_shards(
    docs: DataFrame, shards: int = 24, seed: int = 7, buckets: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`), and source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
    )
    told = [F.lit(f"{seed}"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_crc").cast("string"), F.col("_size").cast("string")]
    alike = rows.groupBy("_id", "_source", "_stratum", "_size", "_crc").agg(F.count("*").alias("_c"))
    alike = alike.withColumn("_h", F.md5(F.concat_ws(":", *told).cast("binary")))
    alike = alike.withColumn("_piece", (F.conv(F.substring("_h", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)).cast("int"))
    pieces = alike.groupBy("_stratum", "_piece").agg(F.sum("_c").alias("_n"))
    by_stratum = Window.partitionBy("_stratum")
    pieces = pieces.select(
        "_stratum", "_piece", F.sum("_n").over(by_stratum).alias("_total"),
        (F.sum("_n").over(by_stratum.orderBy("_piece")) - F.col("_n")).alias("_before"),
    )
    in_piece = Window.partitionBy("_stratum", "_piece").orderBy("_h", "_id", "_crc", "_size")
    last = F.col("_before") + F.sum("_c").over(in_piece.rowsBetween(Window.unboundedPreceding, 0))
    ranked = alike.join(pieces, ["_stratum", "_piece"]).withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    # rank r of n lies in the cut (2r - 1) * buckets div 2n; alike rows in several cuts are parted by them
    cut = lambda r: f"((2L * {r} - 1) * {buckets}L) div (2L * _total)"
    ranked = ranked.withColumn("_cut", F.explode(F.expr(f"sequence({cut('_first')}, {cut('_last')})")))
    # the first rank of a cut: the smallest r with (2r - 1) * buckets >= cut * 2n
    start = lambda c: f"(({c}) * 2L * _total + {3 * buckets - 1}L) div {2 * buckets}L"
    ranked = ranked.withColumns({
        "_from": F.greatest(F.col("_first"), F.expr(start("_cut"))), "_to": F.least(F.col("_last"), F.expr(start("_cut + 1")) - 1),
    }).where("_from <= _to")
    cuts = ranked.groupBy("_cut").agg(F.sum(F.col("_to") - F.col("_from") + 1).alias("_n"))
    whole = Window.partitionBy(F.lit(0))  # at most `buckets` rows
    cuts = cuts.select(
        "_cut", F.sum("_n").over(whole).alias("_all"),
        (F.sum("_n").over(whole.orderBy("_cut")) - F.col("_n")).alias("_ahead"),
    )
    placed = ranked.join(cuts, "_cut").withColumn("_rank", F.explode(F.expr("sequence(_from, _to)")))
    in_cut = Window.partitionBy("_cut").orderBy((2 * F.col("_rank") - 1) / (2 * F.col("_total")), "_stratum", "_rank")
    placed = placed.withColumn("_at", F.col("_ahead") + F.row_number().over(in_cut) - 1)
    placed = placed.withColumn("_shard", F.expr(f"(_at * {shards}L) div _all"))
    first = F.expr(f"(_shard * _all + {shards - 1}L) div {shards}L")  # smallest position of the shard
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("_source").alias("source"),
    )
