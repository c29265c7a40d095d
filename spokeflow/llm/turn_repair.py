"""Repair of the structure of conversations by the cheapest edits.

The initials of the roles must read `(s?(ua)+)?`: at most one system turn, then user and assistant in turn. Turns can be
kept, given another role, deleted, or inserted empty, each at a cost; a recursive query of DuckDB finds the cheapest edits of
all conversations of a batch at once. Each recursion advances one turn and keeps, for each state of the grammar, the least
cost and the letters of the edits (the audit), least in ASCII order among equals.

Conversations may be of any length, and one may hold most of all rows. Rows are dealt out by ranges of (conversation, turn)
and packed into pieces of up to `PIECE` turns. A piece is walked from every state it may begin in, so its result is
a table from state to state, and such tables are joined by the same query, `PIECE` at a time, until a conversation has one. That
is exact: of two audits of equal cost over the same turns none begins with the other, for each turn has one letter and inserted
ones cost more, so the least audit is made of least parts.

What a conversation gathers in one place is what its row of the result holds anyway (a letter a turn) and a summary of each
piece, which takes less. The text of pieces is hashed in their order as a stream, as SHA-256 has it.

Defined cases: null roles and texts count as one space, so such a text is blank; a null conversation is a conversation of its
own; null turns come first; turns of one number are ordered by role, the first characters of the text and its hash, and equal rows
are interchangeable; a role of no characters has no initial and must be given another or go; texts of any length are
read whole; an empty table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.lineage import bounded_batches, written

PIECE = 64  # turns of a piece, and pieces that are joined at once
STEPS = 8192  # turns or tables that one query takes
WHITE = " \t\n\x0b\x0c\r"
STATES = "-sua"  # nothing yet, then the initial that stands last
NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
FINISH = {"-": "", "s": "II", "u": "I", "a": ""}  # what must still be inserted at the end

WALK = """
WITH RECURSIVE walk(g, first, state, k, cost, audit) USING KEY (g, first, state) AS (
  SELECT g, first, first, 0, 0::BIGINT, '' FROM lengths, starts
  UNION
  SELECT w.g, w.first, e.goal, w.k + 1, min({'c': w.cost + e.cost, 'a': w.audit || e.audit}).c, min({'c': w.cost + e.cost, 'a': w.audit || e.audit}).a
  FROM walk w JOIN steps s ON s.g = w.g AND s.k = w.k JOIN edges e ON e.e = s.e AND e.start = w.state
  GROUP BY w.g, w.first, w.k, e.goal
)
SELECT g, first, state, cost, audit FROM walk JOIN lengths USING (g) WHERE k = n ORDER BY g, first, state
"""

_PARTS = "array<struct<start:string,goal:string,cost:bigint,audit:string>>"
_STATS = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"


def turn_edges(initial: str, gone: bool, unfinished: bool) -> list[tuple[str, str, int, str]]:
    """(state, state after it, cost, letters) of every way past one turn, the best for each pair of states.

    More than two insertions in a row are never cheapest: any two that follow each other may be left out.
    """
    best: dict[tuple[str, str], tuple[int, str]] = {}
    more = UNFINISHED * unfinished
    for start in STATES:
        at = start
        for inserted in range(3):
            ways = [(at, DELETE, "D")]
            if not gone:
                ways.append((NEXT[at], REROLE + more, "R"))
                if initial == NEXT[at] or initial == "s" and at == "-":
                    ways.append((initial, more, "K"))
            for goal, cost, letter in ways:
                way = (INSERT * inserted + cost, "I" * inserted + letter)
                best[start, goal] = min(way, best.get((start, goal), way))
            at = NEXT[at]
    return [(start, goal, cost, audit) for (start, goal), (cost, audit) in best.items()]


#: A turn is one of twelve kinds, (initial, gone, unfinished), or none: a row that only stands for its conversation.
KINDS = [(i, g, u) for i in ("s", "u", "a", "") for g, u in ((False, False), (False, True), (True, False))]
_KIND_EDGES = [(k, *e) for k, kind in enumerate(KINDS) for e in turn_edges(*kind)] + [(len(KINDS), s, s, 0, "") for s in STATES]
_EDGE = pa.schema([("e", pa.int64()), ("start", pa.string()), ("goal", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


class _Walker:
    """The recursive query over one batch of groups of steps."""

    def __init__(self):
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._db.register("starts", pa.table({"first": list(STATES)}))

    def walk(self, steps: pa.Table, edges: pa.Table, lengths: list[int]) -> list[list[dict]]:
        """For each group the table of its edges."""
        self._db.register("steps", steps)
        self._db.register("edges", edges)
        self._db.register("lengths", pa.table({"g": pa.array(range(len(lengths)), pa.int64()), "n": pa.array(lengths, pa.int64())}))
        out: list[list[dict]] = [[] for _ in lengths]
        for g, start, goal, cost, audit in self._db.execute(WALK).fetchall():
            out[g].append({"start": start, "goal": goal, "cost": cost, "audit": audit})
        return out


def _groups(lengths: np.ndarray, most: int = STEPS) -> Iterator[tuple[int, int]]:
    """Runs of groups that hold about `most` steps together."""
    at = held = 0
    for i, n in enumerate(lengths.tolist()):
        held += n
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def _positions(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def packed(rows: DataFrame, conv: str, turn: str, role: str, text: str, stands: Column | None = None, piece: int = PIECE) -> DataFrame:
    """Written pieces: conv, seq (rising with conversation and turn), and arrays of what their turns are.

    Where `stands` is false a row is no turn and only makes its conversation appear.
    """
    bounded_batches(rows.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    alive = F.lit(True) if stands is None else stands
    told = F.concat(F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("")), F.lit("\0"), role_, F.lit("\0"), text_)
    trimmed = F.rtrim(text_, F.lit(WHITE))
    flat = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"), F.unhex(F.md5(told)).alias("hash"),
        F.substring(role_, 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"), alive.alias("alive"),
        F.substring(text_, 1, 64).alias("_lead"), F.xxhash64(text_).alias("_h"), F.spark_partition_id().alias("_from"),
    )
    order = ["_conv", "turn", "role", "_lead", "_h", "_from"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_lead", "_h", "_from")
    names = [c for c in flat.columns if c != "_conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                same = np.array([a == b for a, b in zip(ids[:-1].to_pylist(), ids[1:].to_pylist())])
                new[1:] = ~same
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, batch.num_rows))
            cuts = np.flatnonzero(_positions(lengths) % piece == 0)
            offsets = pa.array(np.append(cuts, batch.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cuts)), pa.array(seq + np.arange(len(cuts))), *lists], names=["_conv", "seq", *names])
            seq += len(cuts)

    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    schema = f"_conv {fields[conv]}, seq bigint, " + ", ".join(f"{n} array<{kinds[n]}>" for n in names)
    return written(flat.mapInArrow(run, schema))


def _repeats(pieces: DataFrame) -> DataFrame:
    """seq and the places in it of turns whose role and text stand earlier in the conversation."""
    turns = pieces.select("seq", F.posexplode(F.arrays_zip("hash", "alive")).alias("k", "_t")).where("_t.alive").select("seq", "k", F.col("_t.hash").alias("hash"))
    first = turns.groupBy("hash").agg(F.count("*").alias("_c"), F.min(F.struct("seq", "k")).alias("_first")).where("_c > 1").drop("_c")
    again = turns.join(written(first), "hash").where(F.struct("seq", "k") > F.col("_first"))
    return again.groupBy("seq").agg(F.collect_list("k").alias("_again"))  # at most a piece's turns


def _walked(pieces: DataFrame) -> DataFrame:
    """_conv, seq, counts of a piece, and its edges from state to state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, edges = _Walker(), pa.table(list(zip(*_KIND_EDGES)), schema=_EDGE)
        number = {kind: i for i, kind in enumerate(KINDS)}
        for batch in batches:
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n not in ("_conv", "seq")}
            lengths = np.array([len(x) for x in at["alive"]], np.int64)
            for low, high in _groups(lengths):
                kinds, stats = [], []
                for i in range(low, high):
                    again, faults, live = set(at["_again"][i] or ()), [0, 0, 0], []
                    for k, (there, blank, unfinished, initial) in enumerate(zip(at["alive"][i], at["blank"][i], at["open"][i], at["initial"][i])):
                        if not there:
                            kinds.append(len(KINDS))
                            continue
                        fault = 0 if blank else 1 if k in again else 2 if unfinished else -1
                        if fault >= 0:
                            faults[fault] += 1
                        kinds.append(number[initial if initial in ("s", "u", "a") else "", fault in (0, 1), fault == 2])
                        live.append((initial, at["turn"][i][k]))
                    turns = [t for _, t in live if t is not None]
                    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(live, live[1:]))
                    ends = (live[0][0], live[-1][0]) if live else (None, None)
                    stats.append((len(live), *faults, illegal, *ends, min(turns, default=None), max(turns, default=None), len(set(turns))))
                n = lengths[low:high]
                steps = pa.table({"g": np.repeat(np.arange(high - low), n), "k": _positions(n), "e": np.array(kinds, np.int64)})
                parts = walker.walk(steps, edges, n.tolist())
                held = [pa.array(v, t.type) for v, t in zip(zip(*stats), stat_fields)]
                cut = batch.slice(low, high - low)
                out = [cut.column("_conv"), cut.column("seq"), *held, pa.array(parts, parts_type)]
                yield pa.RecordBatch.from_arrays(out, names=["_conv", "seq", *[t.name for t in stat_fields], "parts"])

    stat_fields = [pa.field(*(lambda c: (c[0], pa.string() if c[1] == "string" else pa.int64()))(c.split())) for c in _STATS.split(", ")]
    parts_type = _parts_type()
    bounded_batches(pieces.sparkSession)
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for isn't made less where rows are few and costly
    light = pieces.select("_conv", "seq", "turn", "initial", "blank", "open", "alive").repartition(parts, "seq")
    light = light.join(_repeats(pieces).repartition(parts, "seq"), "seq", "left")
    light = light.select("_conv", "seq", "turn", "initial", "blank", "open", "alive", "_again")
    kind = pieces.schema["_conv"].dataType.simpleString()
    return written(light.mapInArrow(run, f"_conv {kind}, seq bigint, {_STATS}, parts {_PARTS}"))


def _parts_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.string()), ("goal", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _joined(tables: DataFrame) -> DataFrame:
    """head, k and parts, `PIECE` consecutive tables of a head joined to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker()
        for batch in batches:
            for i in range(batch.num_rows):  # a group at a time: its letters may be many
                group = batch.column(2)[i].as_py()
                rows = [(e, *(p[c] for c in ("start", "goal", "cost", "audit"))) for e, x in enumerate(group) for p in x["parts"]]
                places = np.arange(len(group))
                steps = pa.table({"g": np.zeros(len(group), np.int64), "k": places, "e": places})
                parts = walker.walk(steps, pa.table(list(zip(*rows)), schema=_EDGE), [len(group)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array(parts, _parts_type())], names=["head", "k", "parts"])

    group = F.floor(F.col("k") / PIECE).alias("_g")
    groups = tables.groupBy("head", group).agg(F.sort_array(F.collect_list(F.struct("k", "parts"))).alias("group"))  # at most PIECE tables
    return written(groups.mapInArrow(run, f"head bigint, k bigint, parts {_PARTS}"))


def _finished(parts: Column) -> Column:
    """Least (cost, audit) of a conversation's table: it begins with nothing, and what is missing at its end is inserted."""
    end = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in FINISH.items() for x in kv]), p["goal"])
    whole = F.transform(F.filter(parts, lambda p: p["start"] == "-"), lambda p: F.struct(
        (p["cost"] + INSERT * F.length(end(p))).alias("cost"), F.concat(p["audit"], end(p)).alias("audit")))
    return F.array_min(whole)


def _conversations(walked: DataFrame) -> DataFrame:
    """Written: head, _conv, counts, cost, audit, and a slice of the audit for each piece."""
    stats = [c.split()[0] for c in _STATS.split(", ")]
    convs = walked.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("seq", *stats))).alias("pieces"))
    convs = written(convs.withColumn("head", F.col("pieces")[0]["seq"]))
    tables = walked.select(F.col("seq").alias("head"), "parts")
    many = convs.where(F.size("pieces") > 1).select("head", F.posexplode("pieces").alias("k", "_p")).select("head", "k", F.col("_p.seq").alias("seq"))
    many = many.join(walked.select("seq", "parts"), "seq").select("head", F.col("k").cast("long").alias("k"), "parts")
    longest = convs.agg(F.max(F.size("pieces"))).first()[0] or 0
    if longest > 1:
        while longest > 1:
            many, longest = _joined(many), -(-longest // PIECE)
        whole = many.select("head", F.col("parts").alias("_whole"))
        tables = tables.join(whole, "head", "left").select("head", F.coalesce("_whole", "parts").alias("parts"))
    found = convs.join(tables.select("head", _finished(F.col("parts")).alias("_best")), "head")
    found = found.select("head", "_conv", "pieces", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, slices = [], []
            for pieces, audit in zip(batch.column("pieces").to_pylist(), batch.column("audit").to_pylist()):
                live = [p for p in pieces if p["n"]]
                illegal = sum(p["illegal"] for p in live) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
                dated = [p for p in live if p["turns"]]
                distinct = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
                gaps = dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0
                counts.append((gaps, *(sum(p[c] for p in live) for c in ("blank", "duplicate", "truncated")), illegal))
                odd, at, shown, own = (len(audit) - audit.count("D")) % 2 == 1, 0, 0, []
                for p in live:
                    end, left = at, p["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    if p is live[-1]:
                        end = len(audit)
                    edits = audit[at:end]
                    own.append({"seq": p["seq"], "edits": edits, "shown": shown, "odd": odd})
                    shown, at = shown + len(edits) - edits.count("D"), end
                slices.append(own)
            out = [pa.array(c, pa.int64()) for c in zip(*counts)] + [pa.array(slices, slice_type)]
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("_conv"), batch.column("cost"), batch.column("audit"), *out], names=[n.split()[0] for n in schema.split(", ")])

    slice_type = pa.list_(pa.struct([("seq", pa.int64()), ("edits", pa.string()), ("shown", pa.int64()), ("odd", pa.bool_())]))
    kind = walked.schema["_conv"].dataType.simpleString()
    schema = f"head bigint, _conv {kind}, cost bigint, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, slices array<struct<seq:bigint,edits:string,shown:bigint,odd:boolean>>"
    return written(found.mapInArrow(run, schema))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stands: Column | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Conversations (head, conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired turns.

    The turns come in parts of up to a piece and what is inserted: head, seq, and `turns`, an array of (edit, role, text). The parts of a
    head in the order of seq are the conversation.
    """
    pieces = packed(rows, conv, turn, role, text, stands, piece)
    found = _conversations(_walked(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for edits, shown, odd, there, roles, texts in zip(*(c.to_pylist() for c in batch.columns[2:])):
                own, turns = iter([(r, t) for a, r, t in zip(there, roles, texts) if a]), []
                for edit in edits:
                    r, t = ("", "") if edit == "I" else next(own)
                    if edit != "D":
                        turns.append({"edit": edit, "role": r if edit == "K" else ROLE["ua"[(shown - odd) % 2]], "text": t})
                        shown += 1
                made.append(turns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, turn_type)], names=["head", "seq", "turns"])

    turn_type = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    slices = found.select("head", F.explode("slices").alias("_s")).select("head", "_s.*")
    with_text = slices.join(pieces.select("seq", "alive", "role", "text"), "seq").select("head", "seq", "edits", "shown", "odd", "alive", "role", "text")
    turns = with_text.mapInArrow(run, "head bigint, seq bigint, turns array<struct<edit:string,role:string,text:string>>")
    return found.drop("slices").withColumnRenamed("_conv", conv), turns


def repaired_hashes(turns: DataFrame) -> DataFrame:
    """head and sha256: of all `role:text` of a conversation, joined by newlines; its parts are hashed in their order as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for head, body in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist()):
                if head != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = head, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(body.encode())
            yield rows_of(done)
        if state:
            yield rows_of([(last, state.hexdigest())])

    def rows_of(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], names=["head", "sha256"])

    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    bodies = turns.where(F.size("turns") > 0).select("head", "seq", body.alias("body"))
    return bodies.repartition("head").sortWithinPartitions("head", "seq").select("head", "body").mapInArrow(run, "head bigint, sha256 string")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults that their conversation and turn decide, for tests of a repair: conv, turn, role, text and stands.

    A dropped row stays with `stands` false, so that its conversation is still there. Nulls count as one space.
    """
    told = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    fault = F.crc32(told.cast("binary")) % 20
    plain = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv), F.col(turn), F.when(fault == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), F.lit(" "))).alias(role),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(plain, "[.!?]", "")).otherwise(plain).alias(text), (fault != 0).alias("stands"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stands: Column | None = None, piece: int = PIECE) -> DataFrame:
    """A row a conversation: its faults, the cost and letters of its repair, and the hash of what was repaired."""
    found, turns = repair(rows, conv, turn, role, text, stands, piece)
    out = found.join(repaired_hashes(turns), "head", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
