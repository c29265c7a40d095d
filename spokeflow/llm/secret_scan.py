"""Secret scans whose false positives a random forest takes out.

Candidates, each a run of one line, are
- values: what follows `=` or `:`, in quotes (to the closing quote) or bare, VALUE characters at least; a value of
  letters alone or digits alone counts only under a name that holds a word of KEYS;
- the password in `scheme://user:password@host`, VALUE characters at least;
- what follows a word of SPOKEN, as in `the password is x`, VALUE characters at least and not letters alone;
- other runs of BARE characters at least without white space, quotes, brackets or separators, but letters or digits alone.
A run between white space is read once: a value is not a candidate again as a bare run.

Each is described by its length, its characters and their transitions (between kinds of characters, and how well they
follow the letter pairs of dictionary words), how much of it dictionary words cover, the path it stands in and the words
beside it. The forest is trained on labelled findings: a table of (string, before, after, path, label), of which
`LABELS` rows at most are taken in the order of a hash, or else `labelled_findings`, where keys and look-alikes are put
into the same contexts, so that no single feature tells them apart.

What counts as a secret there: keys of known formats anywhere; random strings and passwords under names of KEYS or in logins;
mixed random strings also without a name. Not: digests under names of PLAIN, bare digests, identifiers, paths,
placeholders, numbers, and random strings without a known format in paths of examples.

Defined cases: null and empty texts have no findings; a null path is an empty one; candidates do not overlap; scores at
the threshold are secrets; repeated rows are scanned each; texts of any length are scanned whole, in time linear in
it; an empty table gives no rows. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import small_batches
from spokeflow.operators.forest import Tree, grow, votes
from spokeflow.plans.lineage import bounded_batches

VALUE, BARE = 6, 12  # least lengths of candidates
NEAR = 64  # characters before a candidate in which its name and neighbouring words are looked for
LABELS = 20_000  # most labelled findings that a forest is trained on
# Words beside secrets, beside digests and identifiers, in paths of examples, and of placeholders.
KEYS = frozenset("token key secret password passwd pwd pass passphrase api apikey auth bearer credential credentials access private client authorization".split())
PLAIN = frozenset("commit sha sha1 sha256 sha512 md5 hash checksum digest integrity revision blob uuid guid etag version build image href src id ref trace request session".split())
EXAMPLES = frozenset("test tests testing example examples sample samples docs doc fixture fixtures mock mocks demo vendor readme".split())
PLACEHOLDERS = frozenset("your example changeme replace placeholder dummy sample insert todo here none null undefined redacted env environ getenv config settings".split())
SPOKEN = re.compile(r"\b(?:password|passwd|pwd|passphrase|secret|token|key)[ \t]+(?:(?:is|was)[ \t]+)?(?=\S)", re.I)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "glpat-", "AIza", "eyJ", "SG.", "npm_")

_STOP = r"\s\"'`<>(){}\[\],;|"
_BARE = re.compile(rf"[^{_STOP}=:&]{{{BARE},}}={{0,2}}")
_PLAIN_VALUE = re.compile(rf"[^{_STOP}=:]+={{0,2}}")
_SEPARATOR = re.compile(r"[:=]")
_LOGIN = re.compile(r"://[^\s/:@\"'<>]{1,256}:([^\s/@\"'<>]+)@")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_NAME = re.compile(r"[\w.\-]+$")
_LETTERS = re.compile(r"[A-Za-z]+")
_EDGE = ".!?*#$%&…~^-_/"
NAMES = [
    "length", "digits", "upper", "lower", "marks", "switches", "entropy", "distinct", "longest_run", "hex", "natural", "covered",
    "dashes", "separated", "prefix", "placeholder", "near_key", "near_plain", "named", "quoted", "in_url", "login", "example_path", "padded", "repeated",
]


@dataclass
class Dictionary:
    """Whole words, and how often a letter follows another in them."""

    words: frozenset[str]
    pairs: dict[str, float]


def dictionary(tokenizer: str) -> Dictionary:
    """Whole words of four letters or more in a byte-level vocabulary."""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = frozenset(t[1:].lower() for t in vocab if t[:1] == "Ġ" and len(t) > 4 and t[1:].isascii() and t[1:].isalpha())
    after, both = Counter(), Counter()
    for w in words:
        after.update(w[:-1])
        both.update(map("".join, zip(w, w[1:])))
    return Dictionary(words, {p: math.log2((c + 0.5) / (after[p[0]] + 13)) for p, c in both.items()})


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _natural(pieces: list[str], known: Dictionary) -> float:
    """Mean logarithm of the letter pairs of a string; pairs that no word has count least."""
    pairs = [p[i : i + 2] for p in pieces for i in range(len(p) - 1)]
    return sum(known.pairs.get(p, -8.0) for p in pairs) / len(pairs) if pairs else -8.0


def _covered(pieces: list[str], known: Dictionary) -> int:
    """Letters that dictionary words cover, taken from the left, the longest first."""
    total = 0
    for p in pieces:
        i = 0
        while i < len(p) - 3:
            n = next((n for n in range(min(16, len(p) - i), 3, -1) if p[i : i + n] in known.words), 0)
            total += n
            i += n or 1
    return total


def near_words(before: str) -> list[str]:
    """The last words before a candidate, in lower case, those of compound names apart."""
    cut = re.sub(r"([a-z])([A-Z])", r"\1 \2", before)
    return [w.lower() for w in _WORD.findall(cut)][-4:]


def features(found: str, before: str, after: str, path: str, known: Dictionary) -> list[float]:
    n = len(found)
    kinds = [_kind(c) for c in found]
    share, count = Counter(kinds), Counter(found)
    runs = longest = same = 1
    most_same = 1
    for a, b, x, y in zip(kinds, kinds[1:], found, found[1:]):
        runs = runs + 1 if a == b else 1
        longest = max(longest, runs)
        same = same + 1 if x == y else 1
        most_same = max(most_same, same)
    lower = found.lower()
    pieces = _LETTERS.findall(lower)
    words = {w for p in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", found) for w in (p.lower(),)}
    near = near_words(before)
    tail = before.rstrip("\"'` ")
    return [
        math.log2(n), share[0] / n, share[1] / n, share[2] / n, share[3] / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(c / n * math.log2(c / n) for c in count.values()), len(count) / n, longest / n, float(all(c in "0123456789abcdef" for c in lower)),
        _natural(pieces, known), _covered(pieces, known) / n, found.count("-") / n, sum(map(found.count, "_-./ ")) / n,
        float(found.startswith(PREFIXES)), float(bool(words & PLACEHOLDERS) or found[:1] in "$<{%"), float(any(w in KEYS for w in near)),
        float(any(w in PLAIN for w in near)), float(tail.endswith(("=", ":"))), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before)),
        float(bool(re.search(r"://\S*$", before)) or found.count("/") > 1), float(bool(re.search(r"://[^\s/:@]+:$", before)) and after[:1] == "@"),
        float(any(w in EXAMPLES for w in re.split(r"[^a-z]+", path.lower()))), float(found.endswith("=")), most_same / n,
    ]


def _simple(s: str) -> bool:
    return s.isalpha() or s.isdigit()


def _trimmed(at: int, s: str) -> tuple[int, str]:
    """Without marks of punctuation around it."""
    cut = s.lstrip(_EDGE)
    return at + len(s) - len(cut), cut.rstrip(_EDGE)


def _keyed_name(text: str, end: int) -> bool:
    """Whether the name that ends before a separator holds a word of KEYS."""
    name = _NAME.search(text[max(0, end - NEAR) : end].rstrip(" \t\"'`:>"))
    return bool(name) and not KEYS.isdisjoint(near_words(name.group()))


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate, in order."""
    found: dict[int, int] = {}
    for m in _SEPARATOR.finditer(text):
        at = m.end()
        if at < len(text) and text[at] in "=:>":
            continue
        while at < len(text) and text[at] in " \t" and at < m.end() + NEAR:
            at += 1
        if at >= len(text):
            continue
        named = _keyed_name(text, m.start())
        if text[at] in "\"'`":
            end = text.find(text[at], at + 1)
            line = text.find("\n", at, end if end >= 0 else None)
            if end < 0 or line >= 0:
                continue
            start, s = at + 1, text[at + 1 : end]
            if not named and any(c.isspace() for c in s):
                continue
        else:
            v = _PLAIN_VALUE.match(text, at)
            if not v:
                continue
            start, s = _trimmed(at, v.group())
        if len(s) >= VALUE and s.strip() and (named or not _simple(s)):
            found.setdefault(start, start + len(s))
    for m in _LOGIN.finditer(text):
        if len(m[1]) >= VALUE:
            found[m.start(1)] = m.end(1)
    for m in SPOKEN.finditer(text):
        v = _PLAIN_VALUE.match(text, m.end())
        if v:
            start, s = _trimmed(m.end(), v.group())
            if len(s) >= VALUE and not s.isalpha():
                found.setdefault(start, start + len(s))
    for m in _BARE.finditer(text):
        start, s = _trimmed(m.start(), m.group())
        if len(s) >= BARE and not _simple(s):
            found.setdefault(start, start + len(s))
    out: list[tuple[int, int]] = []
    for start in sorted(found):
        if not out or start >= out[-1][1]:
            out.append((start, found[start]))
    return out


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """Start, string, and the text before and after of every candidate."""
    for a, b in spans(text):
        yield a, text[a:b], text[max(0, a - NEAR) : a], text[b : b + 2]


def labelled_findings(count: int, seed: int, known: Dictionary) -> list[tuple[str, str, str, str, int]]:
    """(string, before, after, path, 1 for a secret), made from formats; secrets and look-alikes share their contexts."""
    r = random.Random(seed)
    vocabulary = sorted(known.words)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: r.choice(vocabulary)
    said = lambda: " ".join(word() for _ in range(r.randint(1, 6))) + " "
    leet = lambda w: "".join({"o": "0", "e": "3", "a": "4", "i": "1", "s": "5"}.get(c, c) if r.random() < 0.6 else c for c in w)
    keyed = [
        lambda: r.choice(["AKIA", "ASIA"]) + some(alnum[:26] + "0123456789", 16), lambda: r.choice(["ghp_", "gho_"]) + some(alnum, 36),
        lambda: r.choice(["sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_"]) + some(alnum, r.randint(20, 30)), lambda: "AIza" + some(alnum + "_-", 35),
        lambda: "eyJ" + some(alnum, r.randint(17, 40)) + ".eyJ" + some(alnum, r.randint(20, 80)) + "." + some(alnum + "_-", 43),
    ]
    mixed = [
        lambda: some(alnum + "+/", 40), lambda: some(alnum + "_-", r.randint(16, 44)), lambda: some(alnum + "+/", 43) + "=", lambda: some(alnum, r.randint(16, 64)),
    ]
    hexes = [lambda: some(hexa, r.choice([32, 40, 64])), lambda: some(hexa.upper(), r.choice([32, 40])), lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))]
    passwords = [
        lambda: leet(word()).title() + r.choice("&!@#$%*") + some("0123456789", r.randint(1, 4)), lambda: word() + some("0123456789", r.randint(1, 4)) + "".join(word() for _ in range(r.randint(0, 4))) + r.choice(["", "", "!", "?"]),
        lambda: some(alnum + "!@#$%^*-_", r.randint(8, 20)), lambda: "-".join(leet(word()) for _ in range(3)) + str(r.randint(0, 99)), lambda: leet(word() + word()) + some("0123456789", 2),
    ]
    plain = [
        lambda: "_".join(word() for _ in range(r.randint(2, 5))), lambda: word() + "".join(word().title() for _ in range(r.randint(1, 3))), lambda: "-".join(word() for _ in range(r.randint(2, 4))),
        lambda: "/".join(word() for _ in range(r.randint(2, 4))) + r.choice(["", ".json", f"/{r.randint(1, 999)}"]), lambda: ".".join(word() for _ in range(r.randint(2, 4))),
        lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:{r.randint(10, 59)}", lambda: some("0123456789", r.randint(8, 19)), lambda: "".join(word() for _ in range(2)),
        lambda: f"{word()}.{r.randint(10, 99)}@{word()}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{word()}",
        lambda: r.choice(["your_api_key_here", "<your-token>", "REPLACE_WITH_YOUR_KEY", "changeme", "${API_KEY}", "os.environ.get", "example-token", "dummy_secret"]),
        lambda: r.choice("x0*-=#A") * r.randint(8, 40), lambda: "${" + word().upper() + "_" + r.choice(["TOKEN", "KEY"]) + "}", lambda: word() + f"_{r.choice(sorted(KEYS))}", lambda: word() + r.choice("*!#%$&") * 3,
    ]
    groups = [keyed, mixed, hexes, passwords, plain]
    out = []
    for _ in range(count):
        kind = r.choices(range(5), [8, 12, 18, 20, 42])[0]
        value = r.choice(groups[kind])()
        role = r.choices(["key", "plain", "word", "none", "login"], [48, 18, 16, 14, 4])[0]
        name = r.choice(["", "", word() + "_", word() + "-"]) + r.choice(sorted(KEYS if role == "key" else PLAIN if role == "plain" else [word()])) + r.choice(["", "", "_value", "2"])
        name = "" if role in ("none", "login") else r.choice([name, name, name.upper(), name.title()])
        sign = r.choice([' = "', "=", ': "', '="', " = '", ": ", '": "', " => '"])
        if role in ("none", "login"):
            sign = f"{word()}://{word()}:" if role == "login" else r.choice(["", "", '"', "https://host/"])
        close = sign[-1:] if sign[-1:] in "\"'" else ""
        before = (said() + name + sign)[-NEAR:]
        after = "@h" if role == "login" else (close + r.choice([" ", "\n", ",", "!", "#", "*"]))[:2]
        path = r.choice(["src/main", "app/config", "deploy/prod", "web", f"src{r.randint(0, 20)}", "tests/data", "docs/examples"])
        example = any(w in EXAMPLES for w in re.split(r"[^a-z]+", path))
        secret = kind == 0 or not example and (
            kind == 1 and role != "plain" or kind in (2, 3) and role in ("key", "login")
        )
        if role == "none" and kind in (3, 4) and (len(value) < BARE or _simple(value)):
            continue  # never a candidate
        out.append((value, before, after, path, int(secret)))
    return out


def train(known: Dictionary, findings: list[tuple[str, str, str, str, int]], trees: int = 40, depth: int = 14, seed: int = 1) -> list[Tree]:
    x = np.array([features(*f[:4], known) for f in findings])
    y = np.array([f[4] for f in findings], float)
    return [grow(x, y, 2, max_depth=depth, min_leaf=2, max_features=6, seed=seed * 1000 + i) for i in range(trees)]


def _sample(labelled: DataFrame) -> list[tuple[str, str, str, str, int]]:
    """At most LABELS rows of a table of labelled findings; rows without a string or label are left out."""
    names = ["string", "before", "after", "path"]
    rows = labelled.where("length(string) > 0 and label is not null").select(*[F.coalesce(c, F.lit("")).alias(c) for c in names], F.col("label").cast("int").alias("label"))
    return [tuple(r) for r in rows.orderBy(F.xxhash64(*names), *names, "label").limit(LABELS).collect()]


def scan(
    docs: DataFrame, tokenizer: str, findings: int = 6000, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None,
) -> DataFrame:
    """One row per candidate: id, start and length in characters, sha256 of the string, score, is_secret."""
    bounded_batches(docs.sparkSession)
    known = dictionary(tokenizer)
    trees = train(known, labelled_findings(findings, 11, known) if labelled is None else _sample(labelled))
    held = docs.sparkSession.sparkContext.broadcast((known, trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, forest = held.value
        for whole in batches:
            for batch in small_batches(whole, 2, 16 << 20):
                rows, x = [], []
                for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    for at, s, before, after in candidates(text or ""):
                        rows.append((i, at, len(s), sha256(s.encode()).hexdigest()))
                        x.append(features(s, before, after, path or "", known))
                if not rows:
                    continue
                v = votes(forest, np.array(x), 2)
                score = v[:, 1] / v.sum(1)
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(c[0], pa.int32())), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3]),
                     pa.array(score), pa.array(score >= threshold)],
                    names=["_id", "start", "length", "string_sha256", "score", "is_secret"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, start bigint, length bigint, string_sha256 string, score double, is_secret boolean")
    return out.withColumnRenamed("_id", id_col)
