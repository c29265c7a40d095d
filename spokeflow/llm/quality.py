"""Quality classification by hierarchical empirical Bayes.

A document classifier gives evidence: the log-likelihood ratio of good against bad, from counts of words and
word shapes. Hosts and paths give priors: the share of good documents of a path is shrunk toward its host's
share, the host's toward the share of all, each by a strength estimated from how much the shares differ more
than chance lets them (method of moments). The posterior odds of a document are its evidence times the prior
odds of its path; it is kept when they reach even.

The evidence takes one Arrow UDF over whole texts. Priors are grouped aggregates with partial sums, one row
per path; they come back by an equi-join, broadcast if their counted rows are within BROADCAST_ROWS and
shuffled, with adaptive skew handling, beyond.

The classifier is fitted on the driver on at most SAMPLE labelled documents (and SAMPLE_CHARS of text), taken in the order of a hash of
their ids, copies and near copies among them once. One half of them gives the word and shape weights, the
other half the regression on top. Bad means labelled low quality or toxic.

Features, all over the whole text: its length, the length of its words, how many of them are different, the commonest, repeated,
in capitals or mere marks, the mean weight of word shapes (a word's first SHAPE signs after runs are shortened), the
heaviest word and the sum of the HEAVY next. Evidence lies within LIMIT, which is odds of 160,000 to one.

Defined cases: a null text counts as empty; a null host or path is a group of its own; without labels of
both kinds there is no evidence and every document is kept; posteriors at a half are kept; repeated rows are judged each,
equally, and count each for their path; texts of any length are scored whole; an empty table gives no rows. Columns of `docs`
may have any names: those added get a prefix that none of them has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import _Memo
from spokeflow.llm.simhash import BKTree, fingerprint
from spokeflow.plans.lineage import bounded_batches, written

SAMPLE = 4000
SAMPLE_CHARS = 100_000_000  # characters of text after which no more of them are taken
SUPPORT = 6  # labelled documents that a word must occur in
BROADCAST_ROWS = 100_000  # paths up to which their shares are sent to every executor, some 10 MB
SHAPE = 8
HEAVY = 3
LIMIT = 12.0  # most evidence of one document, as a logarithm
_STRIP = re.compile(r"^\W+|\W+$")


def shape(word: str) -> str:
    """A word with letters as a or A, digits as 0 and runs shortened, as in `Aa,` or `A!`."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:SHAPE])


def terms(bare: str) -> tuple[str, ...]:
    """A word in lower case and its first four letters, which carry a family of words."""
    return (bare, f"^{bare[:4]}") if len(bare) > 4 else (bare,)


@dataclass
class Model:
    """Weights of words and word beginnings, shape weights and the regression of both heads (low quality, toxic)."""

    words: dict[str, float] = field(default_factory=dict)
    shapes: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    prior: float = 0.5  # share of good documents it was fitted on

    def __post_init__(self):
        self._seen = _Memo(self._look, 120_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _look(self, word: str) -> tuple[float, float, bool, int]:
        bare = _STRIP.sub("", word).lower()
        return max(self.words.get(t, 0.0) for t in terms(bare)), self.shapes.get(shape(word), 0.0), not bare, sum(map(str.isupper, word))

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        n = len(words)
        if not n:
            return [0.0] * 10
        counts = Counter(words)
        look = self._seen
        hits, shaped, marks, upper = [], 0.0, 0, 0
        for w, c in counts.items():
            weight, s, bare, capitals = look[w]
            if weight > 0:
                hits.append(weight)
            shaped += c * s
            upper += c * capitals
            if bare:
                marks += c
        hits.sort(reverse=True)
        same = sum(map(str.__eq__, words, words[1:]))
        letters = len(text)
        return [
            math.log1p(n), letters / n, len(counts) / n, max(counts.values()) / n, same / n,
            upper / letters, marks / n, shaped / n, hits[0] if hits else 0.0, sum(hits[1 : 1 + HEAVY]),
        ]

    def bad(self, x: np.ndarray) -> np.ndarray:
        """Probability of bad for feature rows."""
        z = (x - np.array(self.mean)) / np.array(self.scale)
        p = [1 / (1 + np.exp(-np.clip(z @ np.array(w[1:]) + w[0], -30, 30))) for w in self.weights]
        return 1 - np.prod([1 - q for q in p], axis=0)

    def evidence(self, texts) -> np.ndarray:
        """Log-likelihood ratio of good against bad."""
        if not len(texts) or not self.weights:
            return np.zeros(len(texts))
        p = np.clip(self.bad(np.array([self.features(t) for t in texts])), 1e-9, 1 - 1e-9)
        return np.clip(np.log((1 - p) / p) - math.log(self.prior / (1 - self.prior)), -LIMIT, LIMIT)


def _log_odds(bad: list[Counter], good: list[Counter], support: int) -> dict[str, float]:
    b, g = Counter(), Counter()
    for c in bad:
        b.update(c.keys())
    for c in good:
        g.update(c.keys())
    odds = lambda w: math.log((b[w] + 0.5) / (len(bad) + 1)) - math.log((g[w] + 0.5) / (len(good) + 1))
    return {w: odds(w) for w in {*b, *g} if b[w] + g[w] >= support}


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps, the bias first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    r = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + r, a.T @ (p - y) + r @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(rows: list[tuple[int, str | None, int, int]]) -> Model:
    """Fit on (id, text, quality, toxic); without both kinds the model has no weights."""
    seen, kept, tree = set(), [], BKTree(3)
    for _, text, quality, toxic in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        f, before = fingerprint(text, 5), len(tree.links)
        if f in seen:
            continue
        seen.add(f)
        tree.connect(f)
        if len(tree.links) == before:
            kept.append((text or "", int(quality == 0), int(toxic == 1)))
    bad = [low or tox for _, low, tox in kept]
    if not any(bad) or all(bad):
        return Model()
    counted = [Counter(t.split()) for t, _, _ in kept]
    bare = [Counter({t for w in c if (b := _STRIP.sub("", w).lower()) for t in terms(b)}) for c in counted]
    shapes = [Counter({shape(w) for w in c}) for c in counted]
    first = range(0, len(kept), 2)
    pick = lambda what, head, v: [what[i] for i in first if kept[i][head] == v]
    toxic = _log_odds(pick(bare, 2, 1), pick(bare, 2, 0), SUPPORT)
    low = _log_odds(pick(shapes, 1, 1), pick(shapes, 1, 0), SUPPORT)
    # a word counts if the other half of the sample bears it out
    rest = range(1, len(kept), 2)
    other = _log_odds([bare[i] for i in rest if kept[i][2]], [bare[i] for i in rest if not kept[i][2]], 2)
    model = Model(
        words={w: min(x, other[w]) for w, x in toxic.items() if x > 1.5 and other.get(w, 0) > 1.5},
        shapes={s: float(np.clip(x, -4, 4)) for s, x in low.items() if abs(x) > 1},
    )
    x = np.array([model.features(kept[i][0]) for i in rest])
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    model.weights = [_regress(z, np.array([kept[i][head] for i in rest], float)) for head in (1, 2)]
    model.prior = 1 - (sum(bad) + 0.5) / (len(bad) + 1)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` labelled documents; that bounds what the driver gathers and what is broadcast."""
    some = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # limited again, since an id may have many rows
    found = rows.join(F.broadcast(some), F.col("_id") == F.col("doc_id")).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(sample)
    held, size = [], 0
    for r in found.select("_id", "_text", "_quality", "_toxic").toLocalIterator():
        held.append((r[0], r[1], r[2], r[3]))
        size += len(r[1] or "")
        if size > SAMPLE_CHARS:
            break
    return train(held)


def evidence(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(texts.tolist()))

    # a pure function, but one that the optimizer must not copy into filters, which would run it twice
    return score.asNondeterministic()(F.coalesce(text, F.lit("")))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables that carry one."""
    return F.parse_url(url, F.lit("HOST")), F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^/([^/]*)", 1)


def _strength(n: float, groups: int, squares: float, spread: float, mean: float) -> float:
    """Pseudo-count of a beta prior: from the variance between groups that sampling doesn't explain.

    n: documents, squares: sum of squared group sizes, spread: sum of size * (group mean - mean)^2.
    """
    within = mean * (1 - mean)
    room = within * (n - squares / n) if n > 0 else 0.0
    if room <= 0:
        return 1e6
    rho = min(max((spread - within * (groups - 1)) / room, 1e-6), 0.999)
    return (1 - rho) / rho


def priors(scored: DataFrame) -> DataFrame:
    """(_host, _path, n, host_share, path_share) from (_host, _path, _p), a row per path.

    The cells are written once: the two strengths and the shares are read from them.
    """
    cells = written(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s")))
    hosts = cells.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((total.s or 0) / (total.n or 1), 1e-6), 1 - 1e-6)
    moments = lambda n, share, around: [
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n.cast("double")).alias("q"), F.sum(n * (share - around) ** 2).alias("v"),
    ]
    h = hosts.agg(*moments(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(mean))).first()
    a = _strength(h.n or 0, h.k, h.q or 0, h.v or 0, mean)
    hosts = hosts.withColumn("host_share", (F.col("hs") + a * mean) / (F.col("hn") + a))
    cells = cells.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    p = cells.agg(*moments(F.col("n"), F.col("s") / F.col("n"), F.col("host_share"))).first()
    b = _strength(p.n or 0, p.k, p.q or 0, p.v or 0, mean)
    shares = cells.select("_host", "_path", "n", "host_share", ((F.col("s") + b * F.col("host_share")) / (F.col("n") + b)).alias("path_share"))
    return shares


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", output: str = "evidence") -> DataFrame:
    """`keep` columns and the evidence, written once: the texts are read a single time for priors and posteriors."""
    bounded_batches(docs.sparkSession)
    return written(docs.select(*keep, evidence(model, F.col(text_col)).alias(output)))


def judged(
    docs: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text", prefix: str = "__", score: Column | None = None,
) -> DataFrame:
    """`docs` with evidence, host_share, path_share, posterior and kept, all under `prefix`.

    `score` is evidence that `docs` has already; without it texts are scored once for the priors and once for
    the posteriors, which spares writing the texts.
    """
    bounded_batches(docs.sparkSession)
    name = lambda c: f"{prefix}{c}"
    col = lambda c: F.col(f"`{prefix}{c}`")
    rows = docs.withColumns({name("host"): host, name("path"): path, name("evidence"): evidence(model, F.col(text_col)) if score is None else score})
    p = 1 / (1 + F.exp(-col("evidence") - math.log(model.prior / (1 - model.prior))))
    shares = priors(rows.select(col("host").alias("_host"), col("path").alias("_path"), p.alias("_p")))
    shares = shares.select(*[F.col(c).alias(name(n)) for c, n in (("_host", "h"), ("_path", "p"), ("host_share", "host_share"), ("path_share", "path_share"))])
    out = rows.join(_sized(shares), col("host").eqNullSafe(col("h")) & col("path").eqNullSafe(col("p")))
    share = F.least(F.greatest(col("path_share"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn(name("posterior"), 1 / (1 + F.exp(-col("evidence") - F.log(share / (1 - share)))))
    kept = col("posterior") >= 0.5 if model.weights else F.lit(True)
    return out.withColumn(name("kept"), kept).drop(name("h"), name("p"))


def _sized(shares: DataFrame) -> DataFrame:
    """A broadcast if the shares, which read from a written table, are counted to be few."""
    return F.broadcast(shares) if shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shares


def keep_good(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with all their columns.

    The documents are written once with their evidence, so that each text is scored once: writing it takes a tenth of that.
    """
    model = fit(docs, labels, sample, text_col=text_col)
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    score = f"{prefix}score"
    rows = scored(docs, model, docs.columns, text_col, score)
    return judged(rows, model, F.col(host_col), F.col(path_col), text_col, prefix, F.col(f"`{score}`")).where(F.col(f"`{prefix}kept`")).select(*docs.columns)
