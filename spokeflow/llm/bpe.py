"""Byte-level BPE with forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be merged across, so a cut between
them is certain. Text is first split as the tokenizer's own pattern splits it; every piece is then cut at
its forced boundaries, the fragments are encoded on their own, and the ids are concatenated. Pieces
recur, so their ids are remembered, up to a fixed number.

Defined cases: a null text counts as empty and has no ids; special tokens written in a text are special
tokens, as the tokenizers library has it; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.lineage import bounded_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 250_000  # pieces in a generation of a worker's memory
SHORT = 32  # bytes up to which a fragment is merged by scanning
LONG = 1 << 20  # characters from which a text is taken a run of pieces at a time
BATCH = 4 << 20  # characters of text in an output batch


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Remembers up to twice `most` short keys; what a generation does not use again is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab, alphabet = j["model"]["vocab"], byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token: list[bytes] = [b""] * size
        self.inside = np.zeros((256, 256), dtype=bool)
        for text, i in vocab.items():
            if text in self.specials:
                continue
            raw = bytes(alphabet[c] for c in text)
            self.token[i] = raw
            for a, b in zip(raw, raw[1:]):
                self.inside[a, b] = True
        for text, i in self.specials.items():
            self.token[i] = text.encode()
        self.byte_id = [vocab.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        self._made: list[int] = []  # the token that the merge of each rank makes
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
            self._rank[vocab[a], vocab[b]] = rank
            self._made.append(vocab[a + b])
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._inside = self.inside.tobytes()
        self._pieces = _Memo(self._cut, REMEMBERED)

    def fragments(self, piece: bytes) -> list[bytes]:
        """`piece` cut at every byte pair that no token holds."""
        if len(piece) < 64:
            inside = self._inside
            at = [0, *[i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not inside[a << 8 | b]], len(piece)]
            return [piece[a:b] for a, b in zip(at, at[1:])]
        raw = np.frombuffer(piece, dtype=np.uint8)
        cuts = np.flatnonzero(~self.inside[raw[:-1], raw[1:]]) + 1
        if not len(cuts):
            return [piece]
        at = [0, *cuts.tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(at, at[1:])]

    def _cut(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._merged, self.fragments(piece.encode()))))

    def _merged(self, fragment: bytes) -> tuple[int, ...]:
        """The merges of lowest rank first, leftmost first among equals; a heap keeps it n log n."""
        ids = [self.byte_id[b] for b in fragment]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        if n <= SHORT:
            return self._merged_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def _merged_short(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges for a few bytes, where scanning a list beats a heap."""
        rank, made = self._rank.get, self._made
        none = len(made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG:
            yield self._split.findall(text)
            return
        found = (m.group() for m in self._split.finditer(text))
        while run := list(islice(found, 100_000)):
            yield run

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts: list[np.ndarray] = []
        get = self._pieces.__getitem__

        def plain(t: str) -> None:
            for run in self._runs(t):
                parts.append(np.fromiter(chain.from_iterable(map(get, run)), np.int32))

        at = 0
        if self._special and any(s in text for s in self.specials):
            for m in self._special.finditer(text):
                plain(text[at : m.start()])
                parts.append(np.array([self.specials[m.group()]], np.int32))
                at = m.end()
        plain(text[at:] if at else text)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[int, ForcedBoundaryBPE] = {}


def loaded(spec: str) -> ForcedBoundaryBPE:
    """The encoder of a file's content; a worker builds it once."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = ForcedBoundaryBPE(spec)
    return _loaded[key]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def small_batches(batch: pa.RecordBatch, column: int, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of a text column, and one row at least."""
    at, held, lengths = 0, 0, pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(np.asarray(lengths, dtype=float))
    for i, n in enumerate(lengths):
        held += n
        if held >= most:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id and ids (array<int>) of every text; with `decode` also the text that the ids stand for.

    `tokenizer` is the path of a tokenizer file on the driver; its content goes to the workers, 1.5 MB
    for a vocabulary of 50,000.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for whole in batches:
            for batch in small_batches(whole, 1):
                ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
                out = [batch.column(0), _lists(ids)]
                if decode:
                    out.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["_id", "ids", "decoded"][: len(out)])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
