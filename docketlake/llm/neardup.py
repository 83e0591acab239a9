"""Near-duplicate records: size-aware prefixes under a global token order, and sketches that bound how far two sets differ."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.plans.session import BROADCAST, checkpoint_bytes, cut

#: Documents of a class that meet in one task; larger classes are cut into blocks of so many.
BLOCK = 2048
#: Documents of one prefix token that meet in one task; a token that more may hold is cut into blocks of so many.
HOT = 16384
#: Prefix tokens that a candidate must share; the prefixes are longer by as many.
MATCHES = 4
#: Counters of the token frequencies, as a power of two: a table of constant size; it is summed in so many slices.
COUNTERS, SLICES = 20, 16
#: Documents and characters that are packed into one row, at most (a longer document has a row of its own).
ROWS, CHARS = 2048, 8 << 20
#: Tasks in which prefix tokens meet, at least, and prefix tokens of a task beyond that.
TASKS, TASK_TOKENS = 12, 4 << 20
#: Pairs that are compared at a time.
PAIRS = 1 << 19

_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the successive runs of lengths n."""
    return np.arange(n.sum()) - np.repeat(_starts(n), n)


def _sort_runs(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat with each of its successive runs of lengths n sorted."""
    out, start = flat.copy(), 0
    for end in np.cumsum(n).tolist():
        out[start:end].sort()
        start = end
    return out


def token_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the runs of `words` successive words, sorted within each text, and their numbers.

    The words of a text stand with one blank between them; null is a text without words.
    """
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()]
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
    runs = np.maximum(0, n - words + 1)
    if not runs.sum():
        return np.zeros(0, np.uint64), runs
    s = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        s = _mixed(s + h[k : k + len(s)])
    s = _sort_runs(s[np.repeat(_starts(n), runs) + _places(runs)], runs)
    doc = np.repeat(np.arange(len(n)), runs)
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]
    return s[new], np.bincount(doc[new], minlength=len(n))


def _pack(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _lines(b: bytes) -> pa.Array:
    """The texts of a packed row; those without words are null."""
    return pa.array([x or None for x in _unpack(b).decode().split("\n")], pa.string())


def documents(df: DataFrame, id: str, text: Column, words: int) -> DataFrame:
    """(k, words, ids, h, texts): packed rows of documents: their number, the words of a shingle, the documents' ids, digests of
    their sets of shingles (null for those without any), and their words, compressed. Rows without an id belong to none.

    Words are runs of letters and digits, in lower case. Whole texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for b in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy().astype(np.int64))
            start = 0
            while start < b.num_rows:
                room = int(np.searchsorted(chars, (chars[start - 1] if start else 0) + CHARS, "right"))
                part = b.slice(start, max(1, min(ROWS, room - start)))
                start += part.num_rows
                lines = [" ".join(_WORD.findall(t.lower().replace("_", " "))) if t else "" for t in part.column(1).to_pylist()]
                sets, n = token_sets(pa.array([x or None for x in lines], pa.string()), words)
                ends = np.cumsum(n)
                digests = [hashlib.blake2b(sets[e - m : e].tobytes(), digest_size=16).digest() if m else None for e, m in zip(ends, n)]
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([words], pa.int32()), one(part.column(0)), one(pa.array(digests, pa.binary())), pa.array([_pack("\n".join(lines).encode())], pa.binary())], ["k", "words", "ids", "h", "texts"]
                )
                k += 1

    rows = df.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"k long, words int, ids array<{dict(rows.dtypes)['id']}>, h array<binary>, texts binary")


def _overlap(n, m, t: float):
    """Tokens that sets of n and m share if their similarity is t or more."""
    return np.ceil((n + m) * (t / (1 + t)) - 1e-9).astype(np.int64)


def _kept(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, tokens, numbers) of each packed row; what is to be left out has no tokens."""
    for k, words, texts, out in zip(*(b.column(c).to_pylist() for c in ("k", "words", "texts", "out"))):
        lines = _lines(texts)
        if out:
            left = np.ones(len(lines), bool)
            left[out] = False
            lines = pc.if_else(pa.array(left), lines, pa.scalar(None, pa.string()))
        yield k, *token_sets(lines, words)


def frequencies(packed: DataFrame) -> tuple[np.ndarray, int]:
    """How common the tokens are: 2 ** COUNTERS counters by the first bits of the token, as quarters of a power of two, and the
    number of all tokens.

    All sets are counted. The table has the same size whatever the number of tokens, so it may go to every task; with
    very many tokens rare ones share counters, and only common ones are still told apart, which are those that matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            for _, s, _ in _kept(b):
                n += np.bincount((s >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(n))
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([_pack(x) for x in n.reshape(SLICES, -1)], pa.binary())], ["slice", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(_unpack(x), np.int64)
        for i, n in sums.items():
            level = np.minimum(127, np.floor(np.log2(np.maximum(n, 1)) * 4)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(n.sum())])], ["slice", "level", "n"])

    kinds = "slice int, n binary"
    got = packed.mapInArrow(count, kinds).repartitionById(SLICES, F.col("slice")).mapInArrow(total, "slice int, level binary, n long").collect()
    out = np.zeros((SLICES, (1 << COUNTERS) // SLICES), np.uint8)
    for r in got:
        out[r.slice] = np.frombuffer(r.level, np.uint8)
    return out.ravel(), sum(r.n for r in got)


def sketches(s: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits of each set: whether the number of its tokens that fall on a bit is odd.

    Tokens that two sets share change the same bits, so the bits that differ are at most the tokens that differ.
    """
    bits = 64 * words
    at = ((s & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * bits + at.astype(np.int64), minlength=len(n) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(n), bits), axis=1).view(np.uint64)


#: What a row of prefixes holds of some documents, for one task: places in the packed row, sizes, sketches, numbers of prefix
#: tokens, and of these the token (32 bits of it), the place in the order and, if any token is cut into blocks, the side.
_PREFIXES = "task int, k long, tokens long, r binary, n binary, sketch binary, m binary, t binary, p binary, side binary"


def _prefixes(common: np.ndarray, t: float, words: int, tasks: int) -> Callable:
    """The first tokens of each set, rarest first, by the task in which they meet."""
    blocks_at = np.ceil(2.0 ** ((np.arange(128) + 1) / 4) / HOT).astype(np.int64)  # the counter is an upper bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, n in _kept(b):
                sketch = sketches(s, n, words)
                level = common[s >> np.uint64(64 - COUNTERS)].astype(np.uint64)
                key = _sort_runs((level << np.uint64(56)) | (s >> np.uint64(8)), n)
                place, doc = _places(n), np.repeat(np.arange(len(n)), n)
                keep = place < np.repeat(n - np.ceil(n * t - 1e-9).astype(np.int64) + 1 + MATCHES, n)
                key, place, doc = key[keep], place[keep], doc[keep]
                tokens = len(key)
                # The documents of a hot token are cut into blocks; block i as the larger of a pair meets block j as the other.
                blocks = blocks_at[(key >> np.uint64(56)).astype(np.int64)]
                side, meets = np.full(tokens, 3, np.uint8), _mixed(key)
                if (blocks > 1).any():
                    own = (_mixed(np.uint64(k) * np.uint64(1 << 20) + doc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    times = np.where(blocks > 1, 2 * blocks, 1)
                    e = np.repeat(np.arange(tokens), times)
                    half = _places(times)
                    cut_up, other = (blocks > 1)[e], half >> 1
                    side = np.where(cut_up, 1 + (half & 1), 3).astype(np.uint8)
                    i, j = np.where(side == 1, own[e], other), np.where(side == 1, other, own[e])
                    meets = np.where(cut_up, _mixed(meets[e] + _mixed((i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64) + np.uint64(1))), meets[e])
                    place, doc = place[e], doc[e]
                task = ((meets >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                bounds = np.searchsorted(task[order], np.arange(tasks + 1))
                out: dict[str, list] = {c.split()[0]: [] for c in _PREFIXES.split(", ")}
                for x in np.flatnonzero(np.diff(bounds)):
                    at = order[bounds[x] : bounds[x + 1]]
                    r, m = np.unique(doc[at], return_counts=True)
                    row = (int(x), k, tokens if not out["task"] else 0, _pack(r.astype(np.int32)), _pack(n[r].astype(np.int32)), sketch[r].tobytes(), _pack(m.astype(np.int32)), meets[at].astype(np.uint32).tobytes(), _pack(place[at].astype(np.int32)), _pack(side[at]) if (side[at] != 3).any() else b"")
                    for c, v in zip(out.values(), row):
                        c.append(v)
                kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[kind]) for c, kind in (x.split() for x in _PREFIXES.split(", "))], list(out))

    return run


def matches(t: float, key: np.ndarray, n: np.ndarray, sketch: np.ndarray, doc: np.ndarray, token: np.ndarray, p: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, c): pairs of documents that share c prefix tokens, x the larger set, and whose sketches let them be similar."""
    share = t / (1 + t)
    # As x has at most 1 / t times its tokens, y's prefix can be the shorter one.
    ys = np.flatnonzero((side & 2 > 0) & (p <= (n - _overlap(n, n, t) + MATCHES)[doc]))
    xs = np.flatnonzero(side & 1)
    code = lambda e, m: (token[e].astype(np.int64) << 31) | m
    ykey = code(ys, n[doc[ys]])
    order = np.argsort(ykey, kind="stable")
    ys, ykey = ys[order], ykey[order]
    xs = xs[np.argsort(code(xs, n[doc[xs]]), kind="stable")]
    nx = n[doc[xs]]
    # Sizes of y that the sizes and the place of the token in x allow; the bounds are a little wide.
    least = np.ceil(t * nx - 1e-6).astype(np.int64)
    most = np.minimum(nx, np.floor((nx - p[xs] + MATCHES) / share - nx + 1e-6).astype(np.int64))
    first = np.searchsorted(ykey, code(xs, least))
    times = np.maximum(0, np.searchsorted(ykey, code(xs, np.maximum(most, 0)), "right") - first)
    some = times > 0
    xs, first, times = xs[some], first[some], times[some]
    ends, found, start = np.cumsum(times), [], 0
    while start < len(xs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        m = times[start:stop]
        x, y = np.repeat(doc[xs[start:stop]], m), np.repeat(first[start:stop], m) + _places(m)
        py, y = p[ys[y]], doc[ys[y]]
        na, nb = n[x], n[y]
        need = np.ceil((na + nb) * share - 1e-9).astype(np.int64)
        ok = (py <= nb - need + MATCHES) & ((nb < na) | (key[y] < key[x]))
        x, y, most_apart = x[ok], y[ok], (na + nb - 2 * need)[ok]
        near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= most_apart
        found.append(x[near] * len(n) + y[near])
        start = stop
    got, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return got // max(1, len(n)), got % max(1, len(n)), c


def _small(df: DataFrame) -> DataFrame:
    """df, materialised, with a hint to broadcast it where its files hold no more than BROADCAST bytes."""
    out = cut(df)
    return F.broadcast(out) if checkpoint_bytes(out) <= BROADCAST else out


class Similar:
    """Classes of equal shingle sets, and the links between their representatives.

    members: (id, rep) for every document with a shingle; rep is the smallest id of its class.
    links: (a, b, similarity) for every pair of representatives, a < b, of Jaccard similarity `threshold` or more.

    Nulls and texts of fewer words belong to no class. Equal texts are one class whatever their number, so they never
    meet in pairs. An empty table has no members and no links.

    Plan: what is kept of the documents is their words, compressed, in packed rows; sets are made again where they are
    needed, which is cheaper than to keep or move them. The order is rarest first, by counters of constant size over all
    sets, so each task orders its own documents. Only prefixes are shuffled, whose length depends on both sizes, with a
    sketch of the whole set. Where the documents of a token meet, a pair leaves the task only if the sketches let it be
    similar, so what leaves follows the similar pairs and not the square of how often a token stands. Pairs that share
    MATCHES tokens of their prefixes in all are verified: the words of the two go to one task, those of no other.
    """

    def __init__(self, docs: DataFrame, threshold: float) -> None:
        t = threshold
        packed = cut(docs)
        each = packed.select("k", F.posexplode(F.arrays_zip("ids", "h")).alias("r", "d")).select(F.col("d.ids").alias("id"), F.col("d.h").alias("h"), "k", "r").filter(F.col("h").isNotNull())
        rows = cut(each)
        self.sets = cut(rows.groupBy("h").agg(F.min(F.struct("id", "k", "r")).alias("d")).select("h", F.col("d.id").alias("rep"), F.col("d.k").alias("k"), F.col("d.r").alias("r")))
        self.members = cut(rows.join(self.sets.select("h", "rep"), "h").select("id", "rep").distinct())
        # Of each class one row is kept: the places of the others are left out of their packed rows.
        copies = _small(rows.join(self.sets.select("k", "r"), ["k", "r"], "left_anti").groupBy("k").agg(F.collect_list("r").alias("out")))
        kept = packed.join(copies, "k", "left").select("k", "words", "texts", "out")
        common, tokens = frequencies(kept)
        tasks = max(TASKS, int(np.ceil(tokens * (1 - t) / TASK_TOKENS)))
        words = int(np.clip(np.ceil(1.75 * tokens / max(1, self.sets.count()) / 64), 1, 64))
        self.prefix = kept.mapInArrow(_prefixes(common, t, words, tasks), _PREFIXES)
        self.met = cut(self._meet(self.prefix, t, words, tasks))
        self.candidates = self.met
        self.links = cut(self._verify(packed, self.sets, self.candidates, t))

    @staticmethod
    def _meet(prefix: DataFrame, t: float, words: int, tasks: int) -> DataFrame:
        """(a, b): places of the pairs that share MATCHES tokens of their prefixes, or all that similar sets share, and whose
        sketches let them be similar. A place is the number of the packed row and the place in it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = []
            for b in batches:
                for k, r, n, sketch, m, token, p, side in zip(*(b.column(c).to_pylist() for c in ("k", "r", "n", "sketch", "m", "t", "p", "side"))):
                    r, n, m, p = (np.frombuffer(_unpack(x), np.int32).astype(np.int64) for x in (r, n, m, p))
                    side = np.frombuffer(_unpack(side), np.uint8) if side else np.full(len(p), 3, np.uint8)
                    parts.append((k * ROWS + r, n, np.frombuffer(sketch, np.uint64).reshape(-1, words), m, np.frombuffer(token, np.uint32), p, side))
            if not parts:
                return
            key, n, sketch, m, token, p, side = map(np.concatenate, zip(*parts))
            x, y, c = matches(t, key, n, sketch, np.repeat(np.arange(len(key)), m), token, p, side)
            need = np.minimum(MATCHES, _overlap(n[x], n[y], t))
            for s in range(0, len(x), 1 << 16):
                i = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[x[i]]), pa.array(key[y[i]]), pa.array(c[i].astype(np.int32)), pa.array(need[i].astype(np.int32))], ["a", "b", "c", "least"])

        met = prefix.drop("tokens").repartitionById(tasks, F.col("task")).mapInArrow(run, "a long, b long, c int, least int")
        return met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("least").alias("least")).filter("c >= least").select("a", "b")

    @staticmethod
    def _verify(packed: DataFrame, sets: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
        """(a, b, similarity): ids of the pairs whose whole sets are similar.

        The words of a stand before those of its partners, so that a task holds one batch of partners at a time.
        """
        place = F.col("k") * ROWS + F.col("r")
        k, r = F.shiftright("at", ROWS.bit_length() - 1).alias("k"), F.col("at").bitwiseAND(ROWS - 1).cast("int").alias("r")
        sides = pairs.select("a", F.col("a").alias("at")).distinct().unionByName(pairs.select("a", F.col("b").alias("at")))
        wanted = _small(sides.select("a", k, r).groupBy("k").agg(F.collect_list(F.struct("a", "r")).alias("wanted")))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, words, texts, wanted in zip(*(b.column(c).to_pylist() for c in ("k", "words", "texts", "wanted"))):
                    lines, small = _unpack(texts).split(b"\n"), {}
                    for start in range(0, len(wanted), ROWS):
                        some = wanted[start : start + ROWS]
                        for w in some:
                            if w["r"] not in small:
                                small[w["r"]] = _pack(lines[w["r"]])
                        yield pa.RecordBatch.from_arrays([pa.array([w["a"] for w in some]), pa.array([k * ROWS + w["r"] for w in some]), pa.array([words] * len(some), pa.int32()), pa.array([small[w["r"]] for w in some], pa.binary())], ["a", "b", "words", "text"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_s = np.zeros(0, np.uint64)
            for b in batches:
                if not b.num_rows:
                    continue
                s, n = token_sets(pa.array([_unpack(x).decode() for x in b.column(3).to_pylist()], pa.string()), b.column(2)[0].as_py())
                first, second = b.column(0).to_numpy(), b.column(1).to_numpy()
                head = np.flatnonzero(first == second)
                # The set of each row's a: of the batch before, or of the last head at or above the row.
                sets = [last_s, *np.split(s, np.cumsum(n)[:-1])]
                at = np.r_[0, head + 1][np.searchsorted(head, np.arange(len(n)), "right")]
                a, y = at[first != second], np.flatnonzero(first != second) + 1
                sizes = np.array([len(x) for x in sets])
                both = sizes[a] + sizes[y]
                flat = _sort_runs(np.concatenate([sets[i] for pair in zip(a, y) for i in pair]), both) if len(a) else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(a)), both)
                same = np.bincount(doc[1:][(flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])], minlength=len(a))
                ok = same >= t * (both - same) - 1e-9
                if len(head):
                    last_s = sets[head[-1] + 1]
                yield pa.RecordBatch.from_arrays([pa.array(first[first != second][ok]), pa.array(second[first != second][ok]), pa.array((same / np.maximum(1, both - same))[ok])], ["a", "b", "similarity"])

        found = packed.join(wanted, "k").select("k", "words", "texts", "wanted").mapInArrow(fetch, "a long, b long, words int, text binary")
        found = found.repartition("a").sortWithinPartitions("a", F.col("a") != F.col("b")).mapInArrow(compare, "a long, b long, similarity double")
        ids = sets.select(place.alias("at"), "rep")
        named = cut(found).join(ids.select(F.col("at").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("at").alias("b"), F.col("rep").alias("y")), "b").filter("x <> y")
        return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of all documents that are similar: every link between representatives is expanded to all
        members of both classes, and every class of equal texts to all its pairs, as many as the square of its size.

        Classes of more than BLOCK members are cut into blocks that meet block by block, here and in links.
        """
        size = self.members.groupBy("rep").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        m = self.members.join(size, "rep").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        several = m.filter("size > 1").withColumn("other", every)
        x, y = several.select("rep", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("x")), several.select("rep", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("y"))
        equal = x.join(y, ["rep", "i", "j"]).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # A link meets the blocks of both its classes one by one.
        blocks = size.select("rep", "blocks")
        wide = self.links.join(blocks.select(F.col("rep").alias("a"), "blocks"), "a").select("a", "b", every.alias("i"))
        wide = wide.join(blocks.select(F.col("rep").alias("b"), "blocks"), "b").select("a", "b", "i", every.alias("j"))
        ma = m.select(F.col("rep").alias("a"), F.col("own").alias("i"), F.col("id").alias("x"))
        mb = m.select(F.col("rep").alias("b"), F.col("own").alias("j"), F.col("id").alias("y"))
        linked = wide.join(ma, ["a", "i"]).join(mb, ["b", "j"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return equal.unionByName(linked)

    def funnel(self) -> DataFrame:
        """(step, n): what each filter leaves: prefix tokens, pairs met whose sketches let them be similar, links."""
        one = F.count("*")
        steps = (("documents", self.members, one), ("distinct", self.sets, one), ("prefix_tokens", self.prefix, F.coalesce(F.sum("tokens"), F.lit(0))), ("met_order_1", self.met, one), ("met_all_orders", self.candidates, one), ("links", self.links, one))
        out = None
        for name, df, n in steps:
            one = df.agg(n.alias("n")).select(F.lit(name).alias("step"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def groups(self) -> DataFrame:
        """(id, class_id, n_links): the smallest id of the document's group, and the number of its similar documents.

        n_links counts the other members of the document's class of equal texts and all members of linked classes.
        """
        size = self.members.groupBy("rep").agg(F.count("*").alias("size"))
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("size").alias("linked")).withColumnRenamed("a", "rep")
        of = components(size.select(F.col("rep").alias("id")), self.links)
        return (
            self.members.join(size, "rep").join(linked, "rep", "left").join(of.withColumnRenamed("id", "rep"), "rep")
            .select("id", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))
        )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id of each node's connected component, over edges (a, b).

    Each round takes the smallest label among a node's neighbours and then the label of that label, so that long chains
    halve; every round is a checkpoint. Only nodes with edges take part in the rounds.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        best = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        hop = label.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = cut(
            label.join(best, "a").join(hop, "l", "left")
            .select("a", "l", F.least("l", "m", F.coalesce("ll", "l")).alias("new"))
        )
        moved = new.filter("new <> l").limit(1).count()
        label = new.select("a", F.col("new").alias("l"))
        if not moved:
            break
    found = label.select(F.col("a").alias("id"), F.col("l").alias("class_id"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
