"""SimHash near-duplicates through BK-trees.

Fingerprint: A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are four
words joined by spaces (fewer words: all of them; none: fingerprint zero). A bit is set when it is set in
over half of the shingles' XXH64 values (seed 42), repeats included.

Link: two fingerprints that differ in `radius` bits or fewer. Fingerprints are first made distinct. If two
of them differ in r bits, then of b equal blocks of the 64 bits at least b - r are untouched; so each
choice of b - r blocks, with their bits, names a shard, and two linked fingerprints share one. Every
shard holds a BK-tree: a node's children are keyed by their Hamming distance to it, and a query that is d
away from a node follows only edges from d - r to d + r. b is the smallest number of blocks that keeps
the shards small for the number of fingerprints at hand; any b finds the same links.

A tree serves to connect, not to list pairs: a node inserted asks only for links into components it is
not yet part of, and a subtree that lies wholly in its own component is skipped, so a dense cluster costs
about one comparison a node and gives one link a node. A shard of over `tree_size` fingerprints is cut
into parts, with one tree for each pair of parts, so no task or tree grows with a shard. That takes a copy of a fingerprint
for each part; where over CROWDED parts would be needed, the bits left open in the shard are cut into radius + 2 further blocks
and each choice of two of them names a shard inside it, if that takes fewer copies. The trees travel by
the shuffle: all of them together grow with the corpus, so a broadcast to every executor would have no
bound. Each tree goes to the one task that queries it. The joins are merges by hint: fingerprints in a file are small, so their size
would have Spark broadcast them with all their copies, which meet in the driver first.

Defined cases: a null text counts as empty; documents without words share fingerprint zero and link like
any other; a null id loses to any other as component id, and a component of null ids has a null one;
repeated rows share a component; texts of any length are taken whole (long ones in runs of words, which give the same
fingerprint); an empty table gives no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import small_batches
from spokeflow.operators.components import connected_components
from spokeflow.plans.lineage import bounded_batches, written

SEED = 42
RADIUS = 4
TREE_SIZE = 3000
CROWDED = 30  # parts of a shard from which narrower shards inside it are tried
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = 1 << 16  # shingles counted at a time


def _runs_of_words(data: bytes) -> Iterator[list[bytes]]:
    """All words at once, or some at a time where a text is long."""
    if len(data) < 1 << 22:
        yield _WORD.findall(data)
        return
    found = (m.group() for m in _WORD.finditer(data))
    while run := list(islice(found, _RUN)):
        yield run


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    h = xxhash.xxh64_intdigest
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _runs_of_words((text or "").encode().translate(_LOWER)):
        words = tail + words
        tail = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes = [h(joined[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        total += len(hashes)
        for at in range(0, len(hashes), _RUN):
            bits = np.array(hashes[at : at + _RUN], dtype=">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    if not total:
        return h(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1, 16 << 20):
                found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(one, blocks - radius)]


def blocks_for(count: int, radius: int, shard: int = 64) -> int:
    """The fewest blocks, up to eight beyond the radius, for which a shard expects `shard` rows at most."""
    for b in range(radius + 1, radius + 9):
        if count / 2 ** (64 * (b - radius) / b) <= shard:
            return b
    return radius + 8


class BKTree:
    """Connects fingerprints within a radius; `links` holds one link for each merge of two components."""

    def __init__(self, radius: int):
        self.radius = radius
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.over: list[int] = []  # a node's parent
        self.one: list[int] = []  # a member if the subtree is one component, else -1
        self.leader: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        leader = self.leader
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    def connect(self, v: int, insert: bool = True) -> None:
        """Link v to what is within the radius, and make it a node unless it is only a query."""
        me = len(self.value)
        self.value.append(v)
        self.kids.append({})
        self.over.append(-1)
        self.one.append(me)
        self.leader.append(me)
        if me == 0:
            return
        radius, value, kids, one, find = self.radius, self.value, self.kids, self.one, self.find
        stack = [0]
        while stack:
            i = stack.pop()
            if one[i] >= 0 and find(one[i]) == find(me):
                continue
            d = (value[i] ^ v).bit_count()
            if d <= radius and (a := find(i)) != (b := find(me)):
                self.leader[max(a, b)] = min(a, b)
                self.links.append((value[i], v))
            if k := kids[i]:
                if len(k) > 2 * radius + 1:
                    stack += [k[x] for x in range(d - radius, d + radius + 1) if x in k]
                else:
                    stack += [j for x, j in k.items() if d - radius <= x <= d + radius]
        if not insert:
            return
        i = 0
        while True:
            if one[i] >= 0 and find(one[i]) != find(me):
                one[i] = -1
            d = (value[i] ^ v).bit_count()
            if d not in kids[i]:
                kids[i][d] = me
                self.over[me] = i
                return
            i = kids[i][d]


def _connect_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, the tree's part before the queries'."""
        key, tree, out = None, None, []
        for batch in batches:
            shard = batch.column(0).to_pylist()
            query = batch.column(1).to_pylist()
            values = batch.column(2).to_numpy().view(np.uint64).tolist()
            for k, q, v in zip(shard, query, values):
                if k != key:
                    if tree:
                        out += tree.links
                    key, tree = k, BKTree(radius)
                tree.connect(v, insert=not q)
            if len(out) > 50_000:
                yield _link_batch(out)
                out = []
        if tree:
            out += tree.links
        yield _link_batch(out)

    return run


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["src", "dst"])


def _narrower(keyed: DataFrame, sizes: DataFrame, masks: list[int], radius: int, tree_size: int, crowded: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows and sizes with narrower shards in place of the crowded ones that these relieve; None if there are none."""
    full = sizes.where(F.col("n") > tree_size * crowded)
    if full.isEmpty():
        return None
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    deeper = []  # for each choice the masks of two of radius + 2 blocks of the bits it leaves open
    for m in masks:
        left = [i for i in range(64) if not m >> i & 1]
        cuts = [len(left) * i // (radius + 2) for i in range(radius + 3)]
        one = [sum(1 << left[i] for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
        deeper.append([signed(x | y) for x, y in combinations(one, 2)])
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in deeper])
    few = F.broadcast(full.select("c", "shard", "n"))  # one for at least tree_size * crowded rows
    rows = keyed.join(few, ["c", "shard"]).select("fp", "c", "shard", "n", F.posexplode(F.get(table, F.col("c"))).alias("k", "mask"))
    rows = written(rows.select("fp", "c", "shard", "n", F.xxhash64("shard", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("inner")))
    own = written(rows.groupBy("c", "shard", "n", "inner").agg(F.count("*").alias("m")))
    copies = lambda n: n * F.ceil(n / tree_size)
    better = own.groupBy("c", "shard", "n").agg(F.sum(copies(F.col("m"))).alias("x")).where(F.col("x") < copies(F.col("n"))).select("c", "shard")
    better = F.broadcast(written(better))
    rows = rows.join(better, ["c", "shard"], "left_semi").select("fp", "c", F.col("inner").alias("shard"))
    own = own.join(better, ["c", "shard"], "left_semi").where("m > 1").select("c", F.col("inner").alias("shard"), F.col("m").alias("n"))
    return keyed.join(better, ["c", "shard"], "left_anti").unionByName(rows), written(sizes.join(better, ["c", "shard"], "left_anti").unionByName(own))


def near_links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, crowded: int = CROWDED) -> DataFrame:
    """Links (src, dst) between distinct fingerprints `fp` that connect all that lie within the radius."""
    count = distinct.count()
    masks = block_masks(radius, blocks_for(count, radius))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", choice.alias("k")).select("fp", "k.c", F.xxhash64("k.c", "k.bits").alias("shard"))
    # written, so that the join shuffles both sides itself and adaptive execution can split a hot shard
    sizes = written(keyed.groupBy("c", "shard").agg(F.count("*").alias("n")).where("n > 1"))
    inner = _narrower(keyed, sizes, masks, radius, tree_size, crowded)
    if inner is not None:
        keyed, sizes = inner
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    rows = keyed.join(sizes.hint("merge"), ["c", "shard"]).select("fp", "shard", parts.alias("parts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    # part p is the tree of cells (p, p..) and asks those of the parts before it
    cells = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, part) AS tree, greatest(x, part) AS asks))")
    rows = rows.select("fp", "shard", "part", F.explode(cells).alias("cell"))
    rows = rows.select(
        F.xxhash64("shard", "cell.tree", "cell.asks").alias("cell"),
        (F.col("part") != F.col("cell.tree")).alias("query"), "fp",
    )
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.rdd.getNumPartitions())
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell", "query", "fp")
    return rows.mapInArrow(_connect_shards(radius), "src bigint, dst bigint")


def simhash_components(
    docs: DataFrame, radius: int = RADIUS, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", tree_size: int = TREE_SIZE,
) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links."""
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("_id").alias("low")))
    links = written(near_links(distinct.select("fp"), radius, tree_size))
    parts = connected_components(links)
    low = distinct.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    low = low.withColumn("part", F.coalesce("component", "fp"))
    named = low.groupBy("part").agg(F.min("low").alias("component_id"))
    by_print = low.select("fp", "part").join(named.hint("merge"), "part").select("fp", "component_id")
    return prints.join(by_print.hint("merge"), "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """The documents of smallest id in their components, with all their columns.

    Ids may repeat with other texts: a document is told by its id and text, of equal ids in a component the text whose MD5 comes first
    stays, a null id only where there is no other, and rows equal in both are one document. Columns are told by their place, so they may have any names.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    found = simhash_components(rows.select(F.struct(own.isNull().alias("none"), own.alias("id"), digest.alias("md5")).alias("key"), text.alias("text")), radius, shingle, "key", "text")
    gone = found.where(F.col("key") != F.col("component_id")).select(F.col("key.id").alias("gone"), F.col("key.md5").alias("md5")).distinct()
    return rows.join(gone, own.eqNullSafe(F.col("gone")) & (digest == F.col("md5")), "left_anti").toDF(*names)
