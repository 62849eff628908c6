"""Quality and toxicity by a generalised additive model with pairwise interactions: cyclic boosting of shallow trees on binned features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh, shared_table
from ._text import U, Words, buffers, lower, mix, slices

#: Labelled documents that a model is fitted on, at most: those of the least hashes of doc_id.
SAMPLE = 20_000
#: Tokens of the learned list at most, how many toxic documents of the sample must have one, and its least log odds.
LEXICON, LEXICON_DOCS, LEXICON_ODDS = 4096, 5, 3.0
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.1
FEATURES = ("words", "word_bytes", "upper", "symbols", "points", "marks", "digits", "lines", "distinct", "repeats", "long_words", "short_words", "listed", "listed_rate")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_KINDS = [_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("#$%&*<>|@^~=_+{}[]\\/"), _table(".,;:'\"()-"), _table("!?|"), _table("0123456789"), _table("\n")]


def tokens(w: Words, data: np.ndarray) -> np.ndarray:
    """For each word its hash and that of its first six bytes, one after the other."""
    folded = lower(data)
    out = np.empty((2, len(w.hash)), U)
    out[0] = w.hash
    head = np.zeros(len(w.hash), U)
    for k in range(6):
        at = w.start + k
        head = head * U(257) + np.where(at < w.end, folded[np.minimum(at, max(0, len(folded) - 1))].astype(U) + U(1), U(0))
    out[1] = mix(head, 77)
    return out


def features(column: pa.Array, lexicon: dict[str, np.ndarray] | None) -> np.ndarray:
    """(n, len(FEATURES)) of whole texts; all 0 for a null or empty one."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    w = Words(data, offsets)
    size, count = np.maximum(np.diff(offsets), 1), np.diff(w.first)
    many = np.maximum(count, 1)
    text = w.text_of()
    length = (w.end - w.start).astype(float)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(text, length, minlength=n) / many
    total = np.zeros(len(data) + 1, np.int64)
    for k, kind in enumerate(_KINDS):
        np.cumsum(kind[data], out=total[1:])
        out[:, 2 + k] = (total[offsets[1:]] - total[offsets[:-1]]) / size
    order = np.lexsort((w.hash, text))
    h, t = w.hash[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    out[:, 8] = np.bincount(t[new], minlength=n) / many
    same = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    out[:, 9] = np.bincount(text[1:][same], minlength=n) / many
    out[:, 10] = np.bincount(text[length > 12], minlength=n) / many
    out[:, 11] = np.bincount(text[length < 4], minlength=n) / many
    if lexicon is not None and len(lexicon["token"]):
        hits = np.zeros(n)
        odds = np.zeros(n)
        for row in tokens(w, data):
            at = np.minimum(np.searchsorted(lexicon["token"], row), len(lexicon["token"]) - 1)
            hit = lexicon["token"][at] == row
            hits += np.bincount(text[hit], minlength=n)
            odds += np.bincount(text[hit], lexicon["odds"][at[hit]], minlength=n)
        out[:, 12] = np.log1p(odds)
        out[:, 13] = hits / many
    return out


# --- the model --------------------------------------------------------------------------------------------------


def _gain(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Values of a tree of depth two over ordered bins, from the gradient and the hessian of each bin."""

    def cut(a: int, b: int) -> int | None:
        if b - a < 2:
            return None
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gain = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl)
        at = int(gain.argmax())
        return a + at + 1 if gain[at] > _gain(g[a:b].sum(), h[a:b].sum()) + 1e-9 else None

    edges = [0, len(g)]
    first = cut(0, len(g))
    if first is not None:
        edges = sorted({0, first, len(g)} | {c for c in (cut(0, first), cut(first, len(g))) if c is not None})
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree with one cut on either axis of a table of two features: its values and its gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        return [a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a]

    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    pg, ph = parts(cg), parts(ch)
    gain = sum(_gain(x, y) for x, y in zip(pg, ph)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = [x[i, j] / (y[i, j] + ridge) for x, y in zip(pg, ph)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


@dataclass
class Additive:
    """log odds = bias + a table for each feature's bin + a table for each chosen pair of coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boosts the features in turn, one shallow tree each a round; then the pairs that the rest speaks for most."""

    def cuts(v: np.ndarray, bins: int) -> np.ndarray:
        values = np.unique(v)
        if len(values) < 2:
            return np.zeros(0)
        at = np.searchsorted(values, np.quantile(v, np.arange(1, bins) / bins), "right")
        at = np.unique(at[at < len(values)])
        return (values[at - 1] + values[at]) / 2  # between two values, so that a frequent one has a bin of its own

    edges, coarse = [cuts(c, BINS) for c in x.T], [cuts(c, COARSE) for c in x.T]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    m = Additive(edges, coarse, float(np.log(rate / (1 - rate))))
    m.tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return m
    fine = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    z = np.full(len(y), m.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            g, h = slope()
            step = RATE * shallow_tree(np.bincount(fine[k], g, len(t)), np.bincount(fine[k], h, len(t)))
            t += step
            z += step[fine[k]]
    g, h = slope()

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(rough[i] * b + rough[j], v, a * b).reshape(a, b)

    gains = sorted(((quadrants(sums(i, j, g), sums(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda r: (-r[0], r[1:]))
    m.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.pair_tables):
            g, h = slope()
            step = RATE * quadrants(sums(i, j, g), sums(i, j, h))[0]
            t += step
            z += step[rough[i], rough[j]]
    return m


# --- Spark ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: dict[str, np.ndarray]
    quality: Additive
    toxic: Additive


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents.

    Several labels of one doc_id count as the greatest of each; rows with a null in either label are left out. Of rows of one doc_id with
    different texts the one of the least features counts. doc_id must be an integer.
    From the sample's texts the executors count in how many documents each word and word head occurs; those that mark toxic
    ones make the list of at most LEXICON tokens. The driver gets the list and the sample's features.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"), F.max("toxic").alias("__t"))
    ids = shared_table(spark, ids.orderBy(F.xxhash64("__id"), "__id").limit(sample), "labels")
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"))
    rows = shared_table(spark, rows.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.col("__q").cast("int").alias("q"), F.col("__t").cast("int").alias("t")), "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffers(part.column("text"))
                w = Words(data, offsets)
                bad = part.column("t").to_numpy()
                text = np.concatenate([w.text_of()] * 2)
                token = tokens(w, data).reshape(-1)
                order = np.lexsort((text, token))
                token, text = token[order], text[order]
                new = np.append(True, (token[1:] != token[:-1]) | (text[1:] != text[:-1]))[: len(token)]
                token, text = token[new], text[new]
                u, inverse = np.unique(token, return_inverse=True)
                n, k = np.bincount(inverse, minlength=len(u)), np.bincount(inverse, bad[text], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(k)], ["token", "n", "k"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("k")).first()
    per = rows.mapInArrow(seen, "token bigint, n bigint, k bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    odds = F.log((F.col("k") + 0.5) / (total.k + 1.0)) - F.log((F.col("n") - F.col("k") + 0.5) / (total.n - total.k + 1.0))
    marked = per.filter(F.col("k") >= LEXICON_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEXICON_ODDS)
    listed = marked.orderBy(F.desc(F.col("odds") * F.sqrt("k")), "token").limit(LEXICON).collect()
    token = np.array([r.token for r in listed], np.int64).view(U)
    order = np.argsort(token)
    lexicon = {"token": token[order], "odds": np.array([r.odds for r in listed])[order]}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("q"), part.column("t"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "q", "t", "x"])

    got = rows.mapInArrow(vectors, "id bigint, q int, t int, x binary").groupBy("id").agg(F.min(F.struct("x", "q", "t")).alias("r")).select("id", "r.*").orderBy("id").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, len(FEATURES))
    y, t = got.column("q").to_numpy().astype(float), got.column("t").to_numpy().astype(float)
    return Model(lexicon, fit(x, y), fit(x, t))


def _scorer(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = features(part.column(text), model.lexicon)
                empty = x[:, 0] == 0
                q, t = model.quality.probability(x), model.toxic.probability(x)
                keep = ~empty & (q >= 0.5) & (t < 0.5)
                old = [(c, f) for c, f in zip(part.columns, part.schema.names) if f != text]
                yield pa.RecordBatch.from_arrays([c for c, _ in old] + [pa.array(q, mask=empty), pa.array(t, mask=empty), pa.array(keep)], [f for _, f in old] + ["__quality", "__toxic", "__keep"])

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __quality and __toxic (probabilities) and __keep: likely good and not likely toxic.

    A text without a word, null and empty ones among them, has null probabilities and isn't kept. Repeated rows each get the
    same result. Without labels both probabilities are 0.5 and nothing is kept. Other columns pass unchanged; those named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in {"__quality", "__toxic", "__keep"}]
    text = fresh(docs, "__text")
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(_scorer(model, text), fields + "__quality double, __toxic double, __keep boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.col("__quality").alias("quality"), F.col("__toxic").alias("toxic"), F.col("__keep").alias("keep"))
