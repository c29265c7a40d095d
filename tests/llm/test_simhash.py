import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spokeflow.llm import registry, simhash
from spokeflow.plans.lineage import written
from tests.oracle import SF


def plain_fingerprint(text, k=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(rows, radius=4):
    """(id, fingerprint) -> id: smallest reachable id, by comparing all pairs."""
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(doc, f"{f:016x}", low.get(find(i))) for i, (doc, f) in enumerate(rows)]


def test_fingerprints(monkeypatch):
    r = random.Random(2)
    texts = [None, "", " \n", "A", "a b c", "a b c d", "a É b c D e"] + [" ".join(r.choice("ABcdé") for _ in range(r.randint(0, 300))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = " ".join(map(str, range(70_000)))
    assert simhash.fingerprint(long) == plain_fingerprint(long)
    monkeypatch.setattr(simhash, "_RUN", 5)
    monkeypatch.setattr(simhash, "_runs_of_words", lambda d: (w[i : i + 3] for w in [simhash._WORD.findall(d)] for i in range(0, len(w), 3)))
    for k in (1, 4, 5):
        assert [simhash.fingerprint(t, k) for t in texts] == [plain_fingerprint(t, k) for t in texts]


@pytest.mark.parametrize("tree_size,crowded", [(3000, 30), (40, 30), (5, 2)])
@pytest.mark.parametrize("count", [10, 10**7])
def test_links_connect_all(spark, tree_size, crowded, count, monkeypatch):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(100)}
    for b in list(fps)[:30]:
        for _ in range(8):
            x = b
            for i in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << i
            fps.add(x)
    hub = r.getrandbits(64)
    for _ in range(250):
        x = hub
        for i in r.sample(range(16), r.randint(1, 7)):
            x ^= 1 << i
        fps.add(x)
    choose = simhash.blocks_for
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: choose(count, radius))
    df = spark.createDataFrame([(int(x),) for x in np.array(sorted(fps), np.uint64).view(np.int64)], "fp long")
    narrow, seen = simhash._narrower, []
    monkeypatch.setattr(simhash, "_narrower", lambda *a: (seen.append(narrow(*a)), seen[-1])[1])
    links = [(a.src & (1 << 64) - 1, a.dst & (1 << 64) - 1) for a in simhash.near_links(df, 4, tree_size, crowded).collect()]
    assert (seen[0] is not None) == (crowded == 2)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    lead = {f: f for f in fps}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        lead[max(x, y)] = min(x, y)
    want = {}
    for i, f, c in components([(i, f) for i, f in enumerate(sorted(fps))]):
        want.setdefault(c, set()).add(int(f, 16))
    found = {}
    for f in fps:
        found.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_query(spark):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in registry.op10_simhash(spark, SF).collect()]
    assert sorted(got) == sorted(components(rows))


def test_cases(spark):
    rows = [(5, None, 1), (2, "", 1), (None, "a b", 1), (None, "a b", 1), (7, "A B", 1), (9, "q w e r t y u", 1), (9, "q w e r t y u", 1), (1, "x " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=repr)
    assert got == sorted(components([(i, plain_fingerprint(t)) for i, t, _ in rows]), key=repr)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    kept = simhash.one_per_component(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()}) == [1, 2, 7, 9]


def test_no_table_of_fingerprints_is_broadcast(spark):
    """Files of fingerprints are small, their copies by shards are not: by the files' size Spark would broadcast them."""
    fps = spark.range(300).select((F.col("id") * 1_000_003).alias("fp"))
    links = simhash.near_links(written(fps))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
