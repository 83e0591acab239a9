"""Encoding with a public byte-level BPE tokenizer, by batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged one by one with a heap; rounds over all words would take as many rounds as such a word has merges.
LONG_WORD = 400
#: Distinct words kept between batches of a Python worker.
KEPT_WORDS = 300_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge table of a tokenizer file: sorted keys of the pairs, their ranks and the ids they merge to."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in _byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(ids.values()) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.none = len(keys)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in the table and rank of each pair (rank `none` where the pair is no merge)."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == self.none] = 0
        return at, np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        long = np.repeat(sizes > LONG_WORD, sizes)
        done_s, done_w = self._rounds(symbols[~long], word[~long])
        for i in np.flatnonzero(sizes > LONG_WORD):
            got = self._heap(symbols[word == i].tolist())
            done_s.append(np.array(got, np.int64))
            done_w.append(np.full(len(got), i))
        s, w = np.concatenate([*done_s, np.zeros(0, np.int64)]), np.concatenate([*done_w, np.zeros(0, np.int64)]).astype(np.int64)
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))

    def _rounds(self, s: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """In each round every word merges all places of its lowest-ranked pair; words without a merge leave."""
        done_s, done_w = [], []
        while len(s):
            at, rank = self.lookup(s[:-1], s[1:])
            rank = np.append(np.where(w[:-1] == w[1:], rank, self.none), self.none)
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(s))))
            ended = lowest == self.none
            done_s.append(s[ended])
            done_w.append(w[ended])
            hit = np.flatnonzero((rank == lowest) & ~ended)
            # Where places overlap (a pair of equal symbols in a row) every other one from the left is merged.
            opens = np.append(True, hit[1:] != hit[:-1] + 1)[: len(hit)]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[nth % 2 == 0]
            s[hit] = self.merged[at[hit]]
            keep = ~ended
            keep[hit + 1] = False
            s, w = s[keep], w[keep]
        return done_s, done_w

    def _heap(self, s: list[int]) -> list[int]:
        """One word of any length: linked symbols and a heap of (rank, place)."""
        n = len(s)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        at, rank = self.lookup(np.array(s[:-1], np.int64), np.array(s[1:], np.int64))
        heap = [(r, i, s[i], s[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), self.merged[at].tolist())) if r < self.none]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    at, rank = self.lookup(np.array([s[x]]), np.array([s[y]]))
                    if rank[0] < self.none:
                        heapq.heappush(heap, (int(rank[0]), x, s[x], s[y], int(self.merged[at[0]])))
        return [v for v, ok in zip(s, alive) if ok]


class Encoder:
    """Encodes batches of texts; remembers the ids of words between batches."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        if len(self.index) > KEPT_WORDS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            flat, sizes = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the number of ids of each text (0 for empty and null ones)."""
        split = [self.split(t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        self._learn(words)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        until = np.append(0, ends)[np.cumsum([len(ws) for ws in split], dtype=np.int64)] if split else np.zeros(0, np.int64)
        return flat, np.diff(np.append(0, until))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text, so that long texts don't pile up."""
    total, begin = 0, 0
    lengths = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    lengths = pc.binary_length(lengths).to_pylist()
    for at, n in enumerate(lengths):
        total += n
        if total >= most:
            yield batch.slice(begin, at + 1 - begin)
            begin, total = at + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _run(text: str, path: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _pieces(whole, text):
                flat, sizes = enc.encode(batch.column(text).to_pylist())
                if ids:
                    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                    out = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                else:
                    out = pa.array(sizes.astype(np.int64))
                at = batch.schema.get_field_index(text)
                names = [n if i != at else "__out" for i, n in enumerate(batch.schema.names)]
                yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return run


def _encode(df: DataFrame, keep: Sequence[str], text: str, name: str, kind: str, path: str) -> DataFrame:
    kinds = dict(df.dtypes)
    picked = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`__out` {kind}"])
    return picked.mapInArrow(_run("__text", path, kind != "bigint"), schema).withColumnRenamed("__out", name)


def token_ids(df: DataFrame, keep: Sequence[str], text: str = "text", name: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """Columns `keep` and the ids of `text` as array<int>; strings that look like special tokens are ordinary text.

    Empty and null texts both have an empty list. One row for each row of df, repeated ones too; no shuffle. Texts
    of any length are encoded whole.
    """
    return _encode(df, keep, text, name, "array<int>", path)


def token_counts(df: DataFrame, keep: Sequence[str], text: str = "text", name: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """As token_ids, with the number of ids (0 for empty and null texts) in their place."""
    return _encode(df, keep, text, name, "bigint", path)
