import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.llm import quality, registry

SMALL = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [tuple(r) for r in docs.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").orderBy(F.xxhash64("doc_id")).select("doc_id", "text", "quality", "toxic").collect()]


def test_held_out_accuracy(rows):
    model = quality.train(rows[:2500])
    test = rows[2500:]
    keep = model.evidence([r[1] for r in test]) + quality.math.log(model.prior / (1 - model.prior)) >= 0
    bad = [r[2] == 0 or r[3] == 1 for r in test]
    assert sum(bool(k) != b for k, b in zip(keep, bad)) / len(test) > 0.98
    caught = [not k for k, r in zip(keep, test) if r[3] == 1]
    assert sum(caught) / len(caught) > 0.97
    good = [bool(k) for k, b in zip(keep, bad) if not b]
    assert sum(good) / len(good) > 0.99


def test_strength_follows_spread(spark):
    flat = [("h%d" % (i % 50), "p", 0.5) for i in range(5000)]
    split = [("h%d" % (i % 50), "p", 1.0 if i % 50 < 25 else 0.0) for i in range(5000)]
    share = lambda rows: {r._host: r.host_share for r in quality.priors(spark.createDataFrame([*rows, ("new", "p", 1.0)], "_host string, _path string, _p double")).collect()}
    a, b = share(flat), share(split)
    assert abs(a["new"] - 0.5) < 0.01  # hosts alike: one document says little
    assert b["h0"] > 0.9 and b["h49"] < 0.1


def test_cases(spark):
    docs = spark.createDataFrame([(1, "x", None, None, 5), (2, None, "h", "p", 5), (3, "", "h", None, 5)], "doc_id long, text string, source string, lang string, __kept int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 3


def test_query_judges_every_document(spark):
    sf = "/root/testdata/sf0.01"
    out = registry.op8_quality(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    wrong = out.join(labels, "doc_id").where("kept <> (quality = 1 and toxic = 0)").count()
    assert wrong <= 0.04 * labels.count()


def test_sites(spark):
    host, path = quality.site(F.lit("https://m.example.org/en/685?x=1"))
    assert tuple(spark.range(1).select(host, path).first()) == ("m.example.org", "en")


def brute(rows, prior, scores):
    """Priors, strengths and posteriors of (id, host, path), all in plain Python."""
    p = [1 / (1 + np.exp(-e - np.log(prior / (1 - prior)))) for e in scores]
    cells, hosts = {}, {}
    for (_, h, c), x in zip(rows, p):
        cells.setdefault((h, c), []).append(x)
        hosts.setdefault(h, []).append(x)
    mean = np.clip(np.mean(p), 1e-6, 1 - 1e-6)

    def strength(groups, around):
        n, within = sum(map(len, groups)), mean * (1 - mean)
        spread = sum(len(g) * (np.mean(g) - a) ** 2 for g, a in zip(groups, around))
        room = within * (n - sum(len(g) ** 2 for g in groups) / n)
        rho = np.clip((spread - within * (len(groups) - 1)) / room, 1e-6, 0.999)
        return (1 - rho) / rho

    a = strength(list(hosts.values()), [mean] * len(hosts))
    host = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    b = strength(list(cells.values()), [host[h] for h, _ in cells])
    path = {k: (sum(g) + b * host[k[0]]) / (len(g) + b) for k, g in cells.items()}
    out = []
    for (i, h, c), e in zip(rows, scores):
        share = np.clip(path[h, c], 1e-6, 1 - 1e-6)
        post = 1 / (1 + np.exp(-e - np.log(share / (1 - share))))
        out.append((i, host[h], path[h, c], post, post >= 0.5))
    return out, a, b


def test_posteriors_against_brute_force(spark):
    """Hosts of many and of single documents, paths of one document, nulls and repeated rows."""
    r = np.random.default_rng(6)
    rows, scores = [], []
    for h in range(40):
        good, tilt = r.uniform(-3, 3), r.normal(0, 2, 12)
        for k in range(int(r.choice([1, 1, 2, 30, 120]))):
            path = int(r.integers(0, 12))
            rows.append((len(rows), f"h{h}" if h else None, f"p{path}" if path else None))
            scores.append(float(np.clip(r.normal(good + tilt[path], 2), -12, 12)))
    rows += rows[:7]
    scores += scores[:7]
    model = quality.Model(weights=[[0.0]], prior=0.7)
    df = spark.createDataFrame([(*x, e) for x, e in zip(rows, scores)], "doc_id long, source string, lang string, score double").repartition(3)
    out = quality.judged(df, model, F.col("source"), F.col("lang"), score=F.col("score"))
    got = sorted(tuple(x) for x in out.select("doc_id", "__host_share", "__path_share", "__posterior", "__kept").collect())
    want, a, b = brute(rows, 0.7, scores)
    assert len(got) == len(want) and 0.01 < a < 100 and 0.01 < b < 1000
    for g, w in zip(got, sorted(want)):
        assert g[0] == w[0] and np.allclose(g[1:4], w[1:4]) and g[4] == w[4]
    alone = [w for w, x in zip(want, rows) if sum(y[1] == x[1] for y in rows) == 1]
    far = np.mean([abs(w[2] - w[1]) for w in want])
    assert alone and np.mean([abs(w[2] - w[1]) for w in alone]) < 2 * far + 0.2


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    data = [tuple(x) for x in docs.select("doc_id", "source", "lang", "text").collect()]
    scores = model.evidence([x[3] for x in data]).tolist()
    want, _, _ = brute([x[:3] for x in data], model.prior, scores)
    got = {x.doc_id: x for x in registry.op8_quality(spark, sf).collect()}
    assert len(got) == len(want)
    for (i, h, p, post, kept), e in zip(want, scores):
        g = got[i]
        assert np.allclose([g.evidence, g.host_share, g.path_share, g.posterior], [e, h, p, post]) and (g.kept == kept or abs(post - 0.5) < 1e-9)


def test_repeated_rows_and_long_texts(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    good, bad = "Plain words of a sentence, and more of them here.", "!!!! #### $$$$ BUY 1111 !!!!"
    rows = [(i, f"{good if i % 2 else bad} {i} " * 5, "h", "p", 1, 2) for i in range(40)]
    rows += [rows[3]] * 30 + [(100, f"{good} " * 60_000, "h", "p", 1, 2), (None, good, None, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __score int, n int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) in (0, 31)
    few = quality.fit(df, labels, sample=20)
    assert few.weights == quality.fit(df.repartition(5), labels, sample=20).weights
