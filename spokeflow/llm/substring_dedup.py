"""Removal of repeated byte strings: bounded interval expansion on a Burrows-Wheeler transform, in shards.

A byte is removed when a string of `length` bytes that covers it also starts anywhere else in the corpus,
the same document included. One transform of a whole corpus fits no machine, so the windows of `length` bytes
are first dealt out by content: each window belongs to the anchor it holds (see `_anchors`), windows with
equal bytes have equal anchors, and the windows of one anchor in a text start side by side (a segment).

1. Count anchors; segments whose anchor occurs once hold nothing that repeats, and go no further.
2. Count equal segments. All windows of a segment that occurs twice repeat; one copy of it goes on.
3. Where an anchor has several different segments, their bytes are fetched, and the segments of whole anchors
   are joined into texts of about CHUNK bytes. Breadth-first backward extension on the transform of such a text
   derives common prefixes by increasing value and stops at `length`; boundaries left over are repeats.
4. Repeated windows go back to all documents that hold the segment, and their bytes are cut out.

An anchor with more than HOT different segments would make too large a text (a passage in a third of all
documents has as many different surroundings). Its windows are split by longer anchors: those with more room behind the
anchor take it with half of that room behind, the others with half of the room before, so equal windows still meet
under equal anchors at equal places. Anchors that are still hot are split again; after eight halvings an anchor is
its window, and equal anchors are equal segments. Splitting changes which text a window is compared in, not the result.

Segments are told apart by 64 bits of their anchor and 64 bits of their content together.

Every step that later steps read more than once is written to the shared folder, and the shuffle files of a
step are dropped when it is written. Documents are told apart by (id, 64-bit hash of the text).

Defined cases: a null text counts as empty; texts shorter than `length` keep all bytes; rows that repeat an id
and a text repeat each other's bytes like any other copies; null ids are matched as equal; texts of any length are
taken whole, very long ones in overlapping slices; an empty table gives no rows. Only the two named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.llm._anchors import long_segments, run_hashes, segments
from spokeflow.llm._bwt import repeated
from spokeflow.llm.bpe import small_batches
from spokeflow.plans.lineage import bounded_batches, written

LENGTH = 200
CHUNK = 1 << 20
HOT = 3000
_SLICE = 1 << 20  # bytes of text scanned at a time
_SPANS = "array<struct<a:int,b:int>>"


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.cast("binary").alias("_bytes"))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row starts; the last entry is the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def anchored(base: DataFrame, length: int) -> DataFrame:
    """_id, _h, first (window), windows, key (anchor), seg (content): the segments of every text."""
    k = max(1, length * 8 // 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 2, _SLICE):
                raw, at = _bytes_of(batch.column(2))
                if len(raw) < 4 * _SLICE:
                    text, first, windows, key, seg = segments(raw, at[:-1], at[1:], length, k)
                else:  # one text of any length ends such a slice
                    parts = [segments(raw[: at[-2]], at[:-2], at[1:-1], length, k)]
                    last = raw[at[-2] :]
                    if len(last) >= length:
                        parts.append(long_segments(last, length, k, _SLICE))
                        parts[-1] = (parts[-1][0] + len(at) - 2, *parts[-1][1:])
                    text, first, windows, key, seg = (np.concatenate(x) for x in zip(*parts))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)),
                     pa.array(windows.astype(np.int32)), pa.array(key), pa.array(seg)],
                    names=["_id", "_h", "first", "windows", "key", "seg"],
                )

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_id {kind}, _h bigint, first int, windows int, key bigint, seg bigint")


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _expanded(length: int, chunk: int):
    """Rows (key, seg, n, windows, bytes) sorted by key and seg -> key, seg, a, b: runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size, last = 0, None

        def found() -> pa.RecordBatch:
            parts, at, place = [], [], 0
            for _, _, _, _, data in held:
                parts += [np.frombuffer(data, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
                at.append(place)
                place += len(data) + 1
            again = repeated(np.concatenate(parts), length)
            out: list[tuple[int, int, int, int]] = []
            for (key, seg, n, windows, _), p in zip(held, at):
                if n == 1:
                    out += [(key, seg, a, b) for a, b in zip(*_runs(again[p : p + windows]))]
            c = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())],
                names=["key", "seg", "a", "b"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:2] == row[:2]:
                    continue  # fetched twice, from rows that repeat an id and a text
                if size >= chunk and row[0] != last:
                    yield found()
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[4]) + 1
        if held:
            yield found()

    return run


_PART = "key bigint, seg bigint, windows int, core int, size int, bytes binary, okey bigint, oseg bigint, oa int"


def _cores(length: int):
    """Segments of hot anchors as parts: the anchor's place is the first run of its hash in the segment's bytes."""
    k = max(1, length * 8 // 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            cores = []
            for key, data in zip(keys, batch.column(3).to_pylist()):
                h = run_hashes(np.frombuffer(data, np.uint8), k).view(np.int64)
                cores.append(int(np.flatnonzero(h == key)[0]))
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cores, pa.int32()), pa.array([k] * n, pa.int32()), batch.column(3),
                 batch.column(0), batch.column(1), pa.array([0] * n, pa.int32())],
                names=["key", "seg", "windows", "core", "size", "bytes", "okey", "oseg", "oa"],
            )

    return run


def _lengthened(length: int):
    """Each part as two at most, whose core is longer by half of the room before or behind it."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, _, windows, core, size, data, okey, oseg, oa in zip(*(c.to_pylist() for c in batch.columns)):
                more = (length - size + 1) // 2
                # window p has core - p bytes before the core; the first ones have the most
                edge = min(max(core - (length - size - more), 0), windows)  # from here on there is room behind
                for a, b, c in ((0, edge, core - more), (edge, windows, core)):
                    if a < b:
                        part = data[a : b + length - 1]
                        c -= a
                        key = digest(part[c : c + size + more], seed=size)
                        out.append((key, digest(part), b - a, c, size + more, part, okey, oseg, oa + a))
            c = list(zip(*out)) or [[]] * 9
            wide = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [wide(c[0]), wide(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.binary()),
                 pa.array(c[6], pa.int64()), pa.array(c[7], pa.int64()), pa.array(c[8], pa.int32())],
                names=["key", "seg", "windows", "core", "size", "bytes", "okey", "oseg", "oa"],
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _h, a, b) sorted by these -> the same with ranges that overlap or touch as one."""
    now: list | None = None
    kind = None
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for i, h, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now[0] == i and now[1] == h and a <= now[3]:
                now[3] = max(now[3], b)
                continue
            if now is not None:
                out.append(tuple(now))
            now = [i, h, a, b]
        if out:
            yield _range_batch(out, kind)
    if now is not None:
        yield _range_batch([tuple(now)], kind)


def _range_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=["_id", "_h", "a", "b"])


def _hot_parts(hot_segments: DataFrame, length: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Parts of hot anchors by longer anchors: (key, seg, n, windows, bytes) to be expanded, and runs that repeat.

    The first come with their segment and place: (okey, oseg, oa). Rows of a part with the same (key, seg) are copies.
    """
    cold, again = [], []
    parts = written(hot_segments.select("key", "seg", "windows", "bytes").mapInArrow(_cores(length), _PART))
    size = max(1, length * 8 // 25)
    while size < length:
        size += (length - size + 1) // 2
        parts = written(parts.mapInArrow(_lengthened(length), _PART))
        each = written(parts.groupBy("key", "seg").agg(F.count("*").alias("n")))
        mixed = written(each.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"))
        counted = parts.join(each, ["key", "seg"])
        again.append(counted.where("n > 1").select("okey", "oseg", F.col("oa").alias("a"), (F.col("oa") + F.col("windows") - 1).alias("b")))
        here = counted.join(mixed, "key")
        cold.append(here.where(F.col("d") <= hot).select("key", "seg", "n", "windows", "bytes", "okey", "oseg", "oa"))
        parts = parts.join(mixed.where(F.col("d") > hot).select("key"), "key", "left_semi")
        if parts.isEmpty():
            break
        parts = written(parts)
    return cold, again


def repeated_windows(base: DataFrame, length: int = LENGTH, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """_id, _h, spans: the byte ranges [a, b) of each text that repeated strings cover, maximal and in order."""
    spark = base.sparkSession
    segs = anchored(base, length)
    # written, so that the join shuffles both sides itself and adaptive execution can split a hot anchor
    several = written(segs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    again = written(segs.join(several, "key", "left_semi"))
    contents = written(
        again.groupBy("key", "seg").agg(
            F.count("*").alias("n"), F.min(F.struct("_id", "_h", "first")).alias("at"), F.max("windows").alias("windows")
        )
    )
    mixed = written(contents.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"))
    wanted = contents.join(mixed, "key").select(
        "key", "seg", "n", "d", "windows", F.col("at._id").alias("_i"), F.col("at._h").alias("_g"), F.col("at.first").alias("_f")
    )
    fetched = base.join(wanted, (F.col("_h") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i"))).select(
        "key", "seg", "n", "d", "windows", F.expr(f"substring(_bytes, _f + 1, windows + {length - 1})").alias("bytes")
    )
    fetched = written(fetched)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = fetched.where(F.col("d") <= hot).select("key", "seg", "n", "windows", "bytes")
    verdict = contents.where("n > 1").select("key", "seg", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
    places = None
    if not mixed.where(F.col("d") > hot).isEmpty():
        cold, runs = _hot_parts(fetched.where(F.col("d") > hot).dropDuplicates(["key", "seg"]), length, hot)
        for r in runs:
            verdict = verdict.unionByName(r.select(F.col("okey").alias("key"), F.col("oseg").alias("seg"), "a", "b"))
        for c in cold:
            texts = texts.unionByName(c.select("key", "seg", "n", "windows", "bytes"))
            own = c.where("n = 1").select("key", "seg", "okey", "oseg", "oa")
            places = own if places is None else places.unionByName(own)
        places = written(places)
    texts = texts.repartition(parts, "key").sortWithinPartitions("key", "seg")
    found = texts.mapInArrow(_expanded(length, chunk), "key bigint, seg bigint, a int, b int")
    if places is not None:
        found = written(found)
        found = found.join(places, ["key", "seg"], "left").select(
            F.coalesce("okey", "key").alias("key"), F.coalesce("oseg", "seg").alias("seg"),
            (F.col("a") + F.coalesce("oa", F.lit(0))).alias("a"), (F.col("b") + F.coalesce("oa", F.lit(0))).alias("b"),
        )
    verdict = verdict.unionByName(found)
    ranges = again.join(verdict, ["key", "seg"]).select(
        "_id", "_h", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + length).alias("b")
    )
    ranges = ranges.repartition(parts, "_id", "_h").sortWithinPartitions("_id", "_h", "a")
    kind = base.schema["_id"].dataType.simpleString()
    spans = ranges.mapInArrow(_merged, f"_id {kind}, _h bigint, a int, b int").groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return written(spans)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk: int = CHUNK,
) -> DataFrame:
    """id, n_bytes, spans (removed, maximal, in order) and kept (the bytes left, end to end) of every document."""
    bounded_batches(docs.sparkSession)
    base = _base(docs, id_col, text_col)
    spans = repeated_windows(base, length, hot, chunk)
    spans = spans.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "spans")
    rows = base.join(spans, (F.col("_h") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i")), "left").select("_id", "_bytes", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1, 8 << 20):
                kept, sizes = [], []
                for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    sizes.append(len(data))
                    at, left = 0, []
                    for s in spans or ():
                        left.append(data[at : s["a"]])
                        at = s["b"]
                    kept.append(b"".join([*left, data[at:]]) if spans else data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())],
                    names=["_id", "n_bytes", "spans", "kept"],
                )

    kind = base.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"_id {kind}, n_bytes bigint, spans {_SPANS}, kept binary")
    return out.select(F.col("_id").alias(id_col), "n_bytes", F.coalesce("spans", F.expr(f"cast(array() AS {_SPANS})")).alias("spans"), "kept")


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(
        id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
