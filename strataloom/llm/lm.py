"""Language-model scoring with an Elias-Fano n-gram trie over words.

The model is an interpolated trigram model with absolute discounts, over all words of the corpus: no word and no n-gram is cut off. Words are
compared without case and punctuation and known by 32 bits of hash, so of a vocabulary of V words about V * V / 2**33 pairs are taken for one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh, posix, remove, shared_dir, tidy_table
from ._text import U, Words, buffers, mix, slices

ORDER = 3
#: Words that a task counts before it writes the counts, and bytes of text that it scores at once.
COUNTED = 1 << 21
BLOCK = 1 << 22
#: Bytes of text for each shard of the trie, about; a shard is built in the memory of one task.
SHARD = 32 << 20
CODES = 256


# --- Elias-Fano -------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value in a row, in 64-bit words, and one word more."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, U)
    if width:
        at = np.arange(n, dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        v = values & U((1 << width) - 1)
        np.bitwise_or.at(out, word, v << shift)
        over = shift + U(width) > U(64)
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence below universe: low bits, unary high bits, and ones before each word of these."""
    n = len(values)
    values = values.astype(U)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> U(width)).astype(np.int64) + np.arange(n)
    size = (n + (universe >> width) + 64) // 64 + 1
    words = np.zeros(size, U)
    np.bitwise_or.at(words, high >> 6, U(1) << (high & 63).astype(U))
    before = np.zeros(size + 1, np.uint32)
    np.cumsum(np.bitwise_count(words), out=before[1:])
    return {"low": _pack(values, width), "high": words, "before": before, "meta": np.array([n, width], np.int64)}


def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th bit that is set in each word: halves are counted, and the one that has it is kept."""
    x, rest, out = words, r.astype(np.int16), np.zeros(len(words), U)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(x & U((1 << half) - 1)).astype(np.int16)
        up = rest >= low
        step = up.astype(U) * U(half)
        rest = rest - low * up
        out += step
        x = x >> step
    return out.astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["meta"])
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]
        self.zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        rest = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return ((self.low[word] >> shift) | rest) & U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, "right") - 1
        place = word * 64 + _in_word(self.high[word], i - self.before[word].astype(np.int64))
        return ((place - i).astype(U) << U(self.width)) | self._low(i)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value below the universe, -1 where it isn't there. Distinct ones are looked up in their order, so that neighbours touch the same memory."""
        if not len(value):
            return np.zeros(0, np.int64)
        by = np.argsort(value)
        value = value[by]
        new = np.append(True, value[1:] != value[:-1])
        out = np.empty(len(by), np.int64)
        out[by] = self._find(value[new])[np.cumsum(new) - 1]
        return out

    def _find(self, value: np.ndarray) -> np.ndarray:
        """A binary search for the successor within the run of its high bits."""
        bucket = (value >> U(self.width)).astype(np.int64)
        z = np.concatenate([np.maximum(bucket - 1, 0), bucket])  # the zeros that end the run before and the run itself
        word = np.searchsorted(self.zeros, z, "right") - 1
        place = word * 64 + _in_word(~self.high[word], z - self.zeros[word])
        n = len(value)
        lo = np.where(bucket > 0, place[:n] + 1, 0) - bucket
        end = place[n:] - bucket
        hi = end.copy()
        want = value & U((1 << self.width) - 1)
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            less = self._low(mid) < want[act]
            lo[act] = np.where(less, mid + 1, lo[act])
            hi[act] = np.where(less, hi[act], mid)
            act = act[lo[act] < hi[act]]
        out = np.full(n, -1, np.int64)
        at = np.flatnonzero(lo < end)
        at = at[self._low(lo[at]) == want[at]]
        out[at] = lo[at]
        return out


# --- counting ---------------------------------------------------------------------------------------------------


def codes(words: Words) -> np.ndarray:
    """32 bits for each word; 0 stands for what is before a text."""
    return np.maximum(words.hash >> U(32), U(1))


def contexts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the last word, the word) at each place."""
    w = codes(words)
    v = np.append(U(0), w[:-1]) if len(w) else w
    v[_begins(words)] = 0
    return v, w


def _begins(words: Words) -> np.ndarray:
    """Places of the first words of texts."""
    return words.first[:-1][np.diff(words.first) > 0]


def shards(level: int, ctx: np.ndarray, log: int) -> np.ndarray:
    """The shard of each context: ranges of words, but level 3 by hash, as one word may begin many bigrams."""
    if not log:
        return np.zeros(len(ctx), np.int64)
    return ((mix(ctx.astype(U)) >> U(64 - log)) if level == 3 else (ctx.astype(U) >> U(32 - log))).astype(np.int64)


def _by_shard(part: np.ndarray) -> np.ndarray:
    """A stable order by shard; numpy sorts 16 bits by radix."""
    return np.argsort(part.astype(np.uint16) if not len(part) or part.max() < 1 << 16 else part, kind="stable")


def counted(level: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in their order, and how often they occur."""
    if not len(w):
        return ctx, w, np.zeros(0, np.int64)
    if int(ctx.max()) >> 32:
        by = np.lexsort((w, ctx))
        ctx, w = ctx[by], w[by]
        at = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])))
        n = np.diff(np.append(at, len(w))) if c is None else np.add.reduceat(c[by], at)
        return ctx[at], w[at], n
    both = ctx << U(32) | w
    if c is None:
        both = np.sort(both)
    else:
        by = np.argsort(both)
        both = both[by]
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    n = np.diff(np.append(at, len(both))) if c is None else np.add.reduceat(c[by], at)
    both = both[at]
    return both >> U(32), both & U(0xFFFFFFFF), n


def _planes(x: np.ndarray) -> bytes:
    """First bytes, second bytes and so on, so that those that are mostly 0 make long runs."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def _pack_counts(ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    at = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(w)))
    step = np.diff(ctx[at].astype(U), prepend=U(0))
    raw = b"".join([np.array([len(at), len(w)], np.int64).tobytes(), _planes(step), _planes(size.astype(np.uint32)), _planes(w.astype(np.uint32)), _planes(c.astype(np.uint32))])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    at = 16 + 8 * n
    ctx, size = np.cumsum(_from_planes(raw, U, n, 16)), _from_planes(raw, np.uint32, n, at)
    w, c = (_from_planes(raw, np.uint32, m, at + 4 * n + k * m) for k in (0, 4))
    return np.repeat(ctx, size), w.astype(U), c.astype(np.int64)


PIECES = "level int, part int, data binary"
MERGED = "level int, part int, file string, size bigint, once bigint, twice bigint, n bigint, total bigint, fan bigint"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _counter(log: int, grams):
    """The counts of the task's n-grams, cut by shard, about COUNTED words at a time. grams(words): (level, contexts, words) of each level."""
    schema = _arrow(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for got in zip(*held):
                level = got[0][0]
                ctx, word, n = counted(level, *(np.concatenate([g[k] for g in got]) for k in (1, 2)))
                part = shards(level, ctx, log)
                if level == 3 and log:
                    by = _by_shard(part)
                    ctx, word, n, part = ctx[by], word[by], n[by], part[by]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                for s, e in zip(cut, np.append(cut[1:], len(part))):
                    yield pa.RecordBatch.from_pylist([{"level": level, "part": int(part[s]), "data": _pack_counts(ctx[s:e], word[s:e], n[s:e])}], schema)

        for batch in batches:
            for piece in slices(batch):
                words = Words.of(piece.column("text"))
                if len(words.hash):
                    held.append(grams(words))
                    size += len(words.hash)
                if size >= COUNTED:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _singles(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
    v, w = contexts(words)
    return [(1, w, np.zeros(len(w), U)), (2, v, w)]


def _merger(folder: str):
    """Brings the counts of each shard together and writes them to a file of the shared folder. Also: n-grams that occur once and twice, all of them, their sum, the most that one context has."""
    schema = _arrow(MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        got: list = []
        at = None

        def done() -> pa.RecordBatch:
            ctx, w, c = counted(at[0], *(np.concatenate(x) for x in zip(*got)))
            path, data = f"{folder}/{at[0]}.{at[1]}-{os.urandom(6).hex()}", _pack_counts(ctx, w, c)
            with open(path, "xb") as f:
                f.write(data)
            first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
            row = *at, path, len(data), int((c == 1).sum()), int((c == 2).sum()), len(c), int(c.sum()), int(np.diff(np.append(first, len(c))).max())
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("level")[i].as_py(), batch.column("part")[i].as_py()
                if got and key != at:
                    yield done()
                    got = []
                at = key
                got.append(_unpack_counts(batch.column("data")[i].as_py()))
        if got:
            yield done()

    return run


def _merge(spark: SparkSession, pieces: DataFrame, folder: str, log: int) -> DataFrame:
    """A row (MERGED) for each shard of the pieces' levels. Every shard is a partition of its own; the shuffle's files go when it is done."""
    place = F.when(F.col("level") == 2, (1 << log) + F.col("part")).otherwise(F.col("part"))
    return tidy_table(spark, pieces.repartitionById(2 << log, place).sortWithinPartitions("level", "part").mapInArrow(_merger(folder), MERGED), "merged")


def merged(level: int, files: list[str], at: list[int], size: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of one shard."""
    got, open_ = [], {}
    try:
        for name, a, n in zip(files, at, size):
            if name not in open_:
                if len(open_) >= 256:
                    open_.pop(next(iter(open_))).close()
                open_[name] = open(name, "rb")
            open_[name].seek(a)
            got.append(_unpack_counts(open_[name].read(n)))
    finally:
        for f in open_.values():
            f.close()
    return got[0] if len(got) == 1 else counted(level, *(np.concatenate(x) for x in zip(*got)))


def _each_shard(shard: DataFrame, level: int, log: int, work, schema: str) -> DataFrame:
    """Rows of work(part, ctx, word, count) for each shard of a level."""
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row = work(r["part"], *merged(level, [r["file"]], [0], [r["size"]]))
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, row))], out)

    return shard.filter(F.col("level") == level).select("part", "file", "size").repartitionById(1 << log, F.col("part")).mapInArrow(run, schema)


# --- files --------------------------------------------------------------------------------------------------------


def quantise(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of a sorted codebook."""
    if not len(book):
        return np.zeros(len(x), np.uint8)
    hi = np.clip(np.searchsorted(book, x), 1, max(1, len(book) - 1))
    if len(book) == 1:
        return np.zeros(len(x), np.uint8)
    return np.where(x - book[hi - 1] <= book[hi] - x, hi - 1, hi).astype(np.uint8)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a list of names, types and lengths, then the arrays, each at a multiple of 64 bytes."""
    import json

    head, at = [], 0
    for name, a in arrays.items():
        head.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        base = -(-f.tell() // 64) * 64
        for (_, _, _, pos), a in zip(head, arrays.values()):
            f.seek(base + pos)
            f.write(a.tobytes())
        f.truncate(base + at)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    import json

    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    base = -(-(8 + n) // 64) * 64
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still mapped; without the subclass's cost for each slice
    return {name: whole[base + at : base + at + np.dtype(kind).itemsize * size].view(kind) for name, kind, size, at in head}


# --- smoothing and trie -----------------------------------------------------------------------------------------


def discount(n1: float, n2: float) -> float:
    return min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5


def book(x: np.ndarray) -> np.ndarray:
    """A codebook: all values where they are few, else half of it quantiles and half of it evenly spaced, so that rare values are near an entry too."""
    u = np.unique(x.astype(np.float32))
    if len(u) <= CODES:
        return u
    half = CODES // 2
    return np.unique(np.concatenate([np.quantile(x, (np.arange(half) + 0.5) / half), np.linspace(u[0], u[-1], half)]).astype(np.float32))


def coded(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """log10 of probabilities in 8 bits."""
    x = np.log10(x).astype(np.float32)
    b = book(x)
    return {f"{name}.code": quantise(x, b), f"{name}.book": b}


def smoothed(ctx: np.ndarray, c: np.ndarray, below: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each context, its back-off weight, probability of each n-gram); n-grams are in the order of their contexts."""
    first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(first, len(ctx)))
    total = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
    weight = d * kinds / np.maximum(total, 1)
    return first, weight, np.maximum(c - d, 0) / np.repeat(total, kinds) + np.repeat(weight, kinds) * below


@dataclass
class Trie:
    """Levels of n-grams in the shared folder, mapped where they are used.

    Level 1 is the sorted vocabulary; a word's number is its place there. Level 2 is cut into ranges of first words: a bigram is the value
    (first word, word) of an Elias-Fano sequence, and pointers, another one, say where each word's successors begin, so that a
    word's rank among the successors of its context is its place less that pointer. Level 3 is cut by the hash of its contexts: a trigram is the value
    (parent, rank of its word among the successors of its middle word). Parents are places in level 2, another sequence.
    """

    log: int
    vocabulary: str | None
    unseen: float = 1.0
    words: int = 0
    fan: int = 1
    two: dict[int, tuple[str, int]] = field(default_factory=dict)  # file and first place of each range
    three: dict[int, str] = field(default_factory=dict)
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _file(self, path: str):
        if path not in self._open:
            if len(self._open) >= 1024:
                self._open.pop(next(iter(self._open)))
            a = map_arrays(path)
            self._open[path] = a, {n: EliasFano({k: a[f"{n}.{k}"] for k in ("low", "high", "before", "meta")}) for n in {k.rpartition(".")[0] for k in a if k.endswith(".meta")}}
        return self._open[path]

    def _vocabulary(self):
        if "words" not in self._open:
            a, _ = self._file(self.vocabulary)
            self._open["words"] = a["code"], a["p.book"][a["p.code"]].astype(np.float64), np.searchsorted(a["code"], np.arange(1 << self.log, dtype=np.int64) << (32 - self.log))
        return self._open["words"]

    def number(self, code: np.ndarray) -> np.ndarray:
        """A word's place in the vocabulary, -1 where it isn't there."""
        have = self._vocabulary()[0]
        if not len(code):
            return np.zeros(0, np.int64)
        by = np.argsort(code)
        code = code[by]
        new = np.append(True, code[1:] != code[:-1])
        one = code[new].astype(np.uint32)
        at = np.minimum(np.searchsorted(have, one), len(have) - 1)
        out = np.empty(len(by), np.int64)
        out[by] = np.where(have[at] == one, at, -1)[np.cumsum(new) - 1]
        return out

    def bigrams(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in level 2 or -1, rank among v's successors, log10 probability, v's log10 back-off weight) for words by number, -1 for unknown ones."""
        _, one, begins = self._vocabulary()
        node, rel, bo = np.full(len(v), -1, np.int64), np.zeros(len(v), np.int64), np.zeros(len(v))
        p = np.where(w >= 0, one[np.maximum(w, 0)], np.log10(self.unseen))
        for part, at in _groups(np.searchsorted(begins, v, "right") - 1, v >= 0):
            if part not in self.two:
                continue
            path, base = self.two[part]
            a, ef = self._file(path)
            own = v[at] - begins[part]
            bo[at] = a["bo.book"][a["bo.code"][own]]
            both = at[w[at] >= 0]
            found = ef["value"].find((v[both] - begins[part]).astype(U) * U(self.words) + w[both].astype(U))
            both, found = both[found >= 0], found[found >= 0]
            node[both] = base + found
            rel[both] = found - ef["pointer"].access(v[both] - begins[part]).astype(np.int64)
            p[both] = a["p.book"][a["p.code"][found]]
        return node, rel, np.where(node >= 0, p, p + bo), bo

    def below(self, parent: np.ndarray, size: np.ndarray, rel: np.ndarray) -> np.ndarray:
        """Probabilities of the bigrams that end trigrams: those of each parent, `size` of them, by their rank among the successors of its last word."""
        _, _, begins = self._vocabulary()
        v, p = np.zeros(len(parent), np.int64), np.zeros(len(rel))
        order = sorted(self.two.values(), key=lambda x: x[1])
        for k, at in _groups(np.searchsorted(np.array([base for _, base in order]), parent, "right") - 1):
            path, base = order[k]
            v[at] = (self._file(path)[1]["value"].access(parent[at] - base) % U(self.words)).astype(np.int64)
        v, which = np.unique(v, return_inverse=True)
        which = np.repeat(which, size)
        first, part = np.zeros(len(v), np.int64), np.searchsorted(begins, v, "right") - 1
        for k, at in _groups(part):
            first[at] = self._file(self.two[k][0])[1]["pointer"].access(v[at] - begins[k]).astype(np.int64)
        for k, at in _groups(part[which]):
            a, _ = self._file(self.two[k][0])
            p[at] = a["p.book"][a["p.code"][first[which[at]] + rel[at]]]
        return 10.0**p

    def trigrams(self, parent: np.ndarray, node: np.ndarray, rel: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probabilities. parent: the context's place in level 2; node, rel, p: of the bigram that ends in the word."""
        p = p.copy()
        for part, at in _groups(shards(3, parent, self.log), parent >= 0):
            if part not in self.three:
                continue
            a, ef = self._file(self.three[part])
            up = ef["parent"].find(parent[at].astype(U))
            at, up = at[up >= 0], up[up >= 0]
            p[at] += a["bo.book"][a["bo.code"][up]]
            also = node[at] >= 0
            at, up = at[also], up[also]
            found = ef["value"].find(up.astype(U) * U(self.fan) + rel[at].astype(U))
            p[at[found >= 0]] = a["p.book"][a["p.code"][found[found >= 0]]]
        return p

    def walk(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the context of two words in level 2 or -1; place, rank, log10 probability of the bigram) at each word of some texts."""
        b, begins = self.number(codes(words)), _begins(words)
        a, parent = np.append(0, b[:-1])[: len(b)], np.full(len(b), -1)
        a[begins] = 0
        node, rel, p, _ = self.bigrams(a, b)
        parent[1:] = node[:-1]
        parent[begins] = -1  # the first word of a text has no context but its beginning
        return parent, node, rel, p

    def score(self, words: Words) -> np.ndarray:
        """log10 probability of each word of some texts."""
        if self.vocabulary is None:
            return np.full(len(words.hash), np.log10(self.unseen))
        return self.trigrams(*self.walk(words))


def _groups(part: np.ndarray, ok: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each part, and the places that have it, of those that are ok."""
    some = np.arange(len(part)) if ok is None else np.flatnonzero(ok)
    part = part[some]
    by = _by_shard(part)
    some, part = some[by], part[by]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.append(cut[1:], len(part))):
        yield int(part[s]), some[s:e]


def train(spark: SparkSession, docs: DataFrame, shard: int = SHARD) -> Trie:
    """Counts, smooths and writes the trie to the shared folder.

    Two passes over the texts: the first counts words and bigrams; the second counts trigrams as (place of the context's bigram in level 2,
    rank of the word among the successors of the middle one), which are small numbers. Each task counts its n-grams by sorting, and the counts are shuffled by shard.
    A shard is merged, and then built, by one task: its share of the vocabulary, of the bigrams or of the
    trigrams, whose contexts are spread by hash, so that a word that everybody uses makes no large one: a context has as many rows as it has different successors. The driver gets the
    discounts (from the numbers of n-grams that occur once and twice) and the files' names. The
    vocabulary is put together by one task, 5 bytes a word.
    """
    text = docs.filter(F.col("text").isNotNull()).select("text")
    folder = posix(f"{shared_dir(spark)}/trie-{os.urandom(6).hex()}")
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log = max(0, int(np.ceil(np.log2(max(1, total / shard)))))
    counts = [f"{folder}/counts{k}" for k in (12, 3)]
    low = _merge(spark, text.mapInArrow(_counter(log, _singles), PIECES), counts[0], log)

    def stats(table: DataFrame, level: int) -> tuple[float, int, int, int]:
        r = table.filter(F.col("level") == level).agg(*[F.sum(x) for x in ("once", "twice", "n", "total")], F.max("fan")).first()
        return discount(r[0] or 0, r[1] or 0), r[2] or 0, r[3] or 0, r[4] or 0

    d1, words, running, _ = stats(low, 1)
    if not words:
        return Trie(0, None)
    words += 1  # and what is before a text
    unseen = d1 * (words - 1) / running / words

    def save(name: str, arrays: dict[str, np.ndarray]) -> str:
        path = f"{folder}/{name}-{os.urandom(6).hex()}"
        save_arrays(path, arrays)
        return path

    def level_one(part: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray):
        return part, save(f"1.{part}", {"code": ctx.astype(np.uint32), "p": (np.maximum(c - d1, 0) / running + unseen)})

    one = [r.path for r in sorted(_each_shard(low, 1, log, level_one, "part int, path string").collect())]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches):
            parts = [map_arrays(p) for p in one]
            p = np.concatenate([[unseen], *[x["p"] for x in parts]])
            yield pa.RecordBatch.from_arrays([pa.array([save("vocabulary", {"code": np.concatenate([np.zeros(1, np.uint32), *[x["code"] for x in parts]]), **coded("p", p)})])], ["path"])

    trie = Trie(log, spark.range(1).coalesce(1).mapInArrow(join, "path string").first().path, unseen, words)
    d2, _, _, fan = stats(low, 2)
    trie.fan = fan + 1

    def level_two(part: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray):
        _, p, begins = trie._vocabulary()
        lo, hi = int(begins[part]), int(begins[part + 1]) if part + 1 < len(begins) else words
        a, b = trie.number(ctx) - lo, trie.number(w)
        first, weight, q = smoothed(ctx, c, 10.0 ** p[b], d2)
        bo = np.ones(hi - lo)
        bo[a[first]] = weight
        arrays = {f"value.{k}": x for k, x in elias_fano(a.astype(U) * U(words) + b.astype(U), max(1, hi - lo) * words).items()}
        arrays |= {f"pointer.{k}": x for k, x in elias_fano(np.searchsorted(a, np.arange(hi - lo + 1)), len(a) + 1).items()}
        return part, save(f"2.{part}", arrays | coded("p", q) | coded("bo", bo)), len(a)

    base = 0
    for r in sorted(_each_shard(low, 2, log, level_two, "part int, path string, n bigint").collect()):
        trie.two[r.part] = r.path, base
        base += r.n
    remove(spark, counts[0])
    trie._open = {}

    def triples(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        parent, node, rel, _ = trie.walk(words)
        inner = (parent >= 0) & (node >= 0)
        return [(3, parent[inner].astype(U), rel[inner].astype(U))]

    high = _merge(spark, text.mapInArrow(_counter(log, triples), PIECES), counts[1], log)
    d3, *_ = stats(high, 3)

    def level_three(part: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray):
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        parents, size = ctx[first].astype(np.int64), np.diff(np.append(first, len(ctx)))
        _, weight, q = smoothed(ctx, c, trie.below(parents, size, w.astype(np.int64)), d3)
        value = np.repeat(np.arange(len(first)), size).astype(U) * U(trie.fan) + w
        arrays = {f"parent.{k}": x for k, x in elias_fano(parents, base + 1).items()}
        arrays |= {f"value.{k}": x for k, x in elias_fano(value, len(first) * trie.fan).items()}
        return part, save(f"3.{part}", arrays | coded("p", q) | coded("bo", weight))

    trie.three = {r.part: r.path for r in _each_shard(high, 3, log, level_three, "part int, path string").collect()}
    remove(spark, counts[1])
    trie._open = {}
    return trie


def _scorer(trie: Trie, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BLOCK):
                words = Words(*buffers(part.column(text)))
                total = np.append(0.0, np.cumsum(trie.score(words)))
                n = np.diff(words.first)
                total = np.where(n > 0, total[words.first[1:]] - total[words.first[:-1]], 0.0)
                ppl = 10.0 ** np.minimum(300.0, -total / np.maximum(n, 1))
                old = [(c, f) for c, f in zip(part.columns, part.schema.names) if f != text]
                yield pa.RecordBatch.from_arrays([c for c, _ in old] + [pa.array(n), pa.array(total), pa.array(ppl, mask=n == 0)], [f for _, f in old] + ["__n_words", "__log_prob", "__perplexity"])

    return run


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs with __n_words, __log_prob (base 10, of the whole text) and __perplexity (of a word).

    A null text and one without words have 0 words, the log probability 0 and a null perplexity. An n-gram that the corpus lacks
    is scored by the next shorter one and the context's back-off weight; a word that it lacks by the unseen mass. Repeated rows each get the
    same score. With a trie of an empty corpus all words have the probability 1. Texts may have any length. Other columns pass unchanged; those
    named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in {"__n_words", "__log_prob", "__perplexity"}]
    text = fresh(docs, "__text")
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(_scorer(trie, text), fields + "__n_words bigint, __log_prob double, __perplexity double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document under the model of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(spark, docs))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "log_prob", "perplexity")])
