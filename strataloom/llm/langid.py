"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import free, fresh, shared_table, whole
from ._text import U, Words, buffers, distinct, lower, mix

FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es")}
DIMENSIONS = 1 << 12
#: Documents of each language in a block, about. Machines are fitted on each block, and the model is their mean over all blocks.
SAMPLE = 400
#: A trigram is known where at least two documents have it and its shares of each language's documents add up to this.
SEEN = 0.005
BLOCK = 1 << 20
#: Least share of known trigrams: this part of the share that all but QUANTILE of the labelled documents reach.
KNOWN, QUANTILE = 0.9, 0.01
#: What a text of n trigrams may fall short of that, divided by the root of n: the share of a short text is a noisy one.
NOISE = 0.5
TABLE = 1 << 20


def _blocks(data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Parts of a long run of bytes that end between characters and, where there is one, at a space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + most)
        if end < n:
            space = np.flatnonzero(data[max(at, end - 4096) : end] <= 32)
            end = max(at, end - 4096) + int(space[-1]) + 1 if len(space) else end
            while end < n and end > at + 1 and 0x80 <= data[end] < 0xC0:
                end -= 1
        yield at, end
        at = end


def _grams(data: np.ndarray, off: np.ndarray, w: Words, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, text, hash) of the byte k-grams of letters within words."""
    folded = lower(data).astype(U)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    alpha = np.cumsum(inside[:-1]).astype(bool) & ~((data >= 48) & (data < 58))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    word = np.cumsum(np.bincount(w.start, minlength=len(data)))
    gram = folded
    for k in range(1, max(sizes) + 1):
        if k > 1:
            gram = gram[: len(data) - k + 1] * U(257) + folded[k - 1 :]
        if k not in sizes:
            continue
        m = len(gram)
        at = np.flatnonzero(alpha[:m] & alpha[k - 1 :] & (word[:m] == word[k - 1 :]))
        yield k, text[at], mix(gram[at], k)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, DIMENSIONS) unit vectors of square-rooted counts of byte 1- to 4-grams within words and of words; letters of each text."""
    x, letters, *_ = _features(column, None)
    return x, letters


def _features(column: pa.Array, table: np.ndarray | None, held: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Also the share of each text's trigrams that table knows, 1 where there is no trigram, and their number. `held` gets text * TABLE + place of each text's trigrams."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    counts = np.zeros((n, DIMENSIONS), np.float32)
    letters, three, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    flat = counts.reshape(-1)
    for a, b in _blocks(data):
        part, off = data[a:b], np.clip(offsets, a, b) - a
        w = Words(part, off)
        for k, text, gram in _grams(part, off, w):
            _add(flat, text * DIMENSIONS + (gram & U(DIMENSIONS - 1)).astype(np.int64))
            if k == 1:
                letters += np.bincount(text, minlength=n)
            if k == 3 and table is not None:
                three += np.bincount(text, minlength=n)
                seen += np.bincount(text[table[(gram & U(TABLE - 1)).astype(np.int64)]], minlength=n)
            if k == 3 and held is not None:
                held.append(distinct(text * TABLE + (gram & U(TABLE - 1)).astype(np.int64)))
        _add(flat, w.text_of() * DIMENSIONS + (mix(w.hash, 9) & U(DIMENSIONS - 1)).astype(np.int64))
    np.sqrt(counts, out=counts)
    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    counts /= np.where(norm > 0, norm, 1)[:, None]
    return counts, letters, np.where(three > 0, seen / np.maximum(three, 1), 1.0), three


def known_share(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each text's trigrams that table knows, and their number."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    three, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in _blocks(data):
        part, off = data[a:b], np.clip(offsets, a, b) - a
        for _, text, gram in _grams(part, off, Words(part, off), (3,)):
            three += np.bincount(text, minlength=n)
            seen += np.bincount(text[table[(gram & U(TABLE - 1)).astype(np.int64)]], minlength=n)
    return seen / np.maximum(three, 1), three


def _packed(x: np.ndarray) -> bytes:
    """A vector in half precision: a bit for each place, the different values that aren't 0, and at each such place a byte that says which one; low bytes first.

    A text's values are roots of its counts, so they are few; where they are over 256 a number of two bytes takes the byte's place.
    """
    half = x.astype(np.float16)
    some = half > 0
    values, which = np.unique(half[some], return_inverse=True)
    which = which.astype(np.uint8 if len(values) <= 256 else np.uint16)
    raw = len(values).to_bytes(2, "little") + np.packbits(some).tobytes() + values.tobytes() + which.view(np.uint8).reshape(-1, which.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), np.uint8)
    n, at = int.from_bytes(raw[:2].tobytes(), "little"), 2 + DIMENSIONS // 8
    values, kind = raw[at : at + 2 * n].copy().view(np.float16), np.uint8 if n <= 256 else np.uint16
    which = np.ascontiguousarray(raw[at + 2 * n :].reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    out = np.zeros(DIMENSIONS, np.float32)
    out[np.unpackbits(raw[2:at]).astype(bool)] = values[which]
    return out


def _add(flat: np.ndarray, at: np.ndarray) -> None:
    if len(at):
        lo = int(at.min())
        seen = np.bincount(at - lo)
        flat[lo : lo + len(seen)] += seen


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss, by accelerated gradient steps.

    y is 1 or -1; both sides weigh the same in sum.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype) * len(y)
    step = 1.0 / (1.0 + 2 * c * float(np.einsum("ij,ij,i->", x, x, weight)) / len(y))
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / len(y) - 2 * c / len(y) * (x.T @ (weight * y * short)))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Model:
    families: list[str]
    family: np.ndarray  # one column for each family
    languages: list[list[str]]
    within: list[np.ndarray]  # for each family a column for each two of its languages, in the order of `contests`
    table: np.ndarray | None = None  # bits of the known trigrams, packed
    known: float = 0.0

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Family, its margin, language, the margin of its closest contest."""
        one = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        score = one @ self.family
        fam = score.argmax(1) if len(x) else np.zeros(0, int)
        lang, margin = np.empty(len(x), object), np.ones(len(x))
        for f, names in enumerate(self.languages):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                best, m = decide(one[rows] @ self.within[f], len(names))
                lang[rows] = np.array(names, object)[best]
                margin[rows] = m
        return np.array(self.families, object)[fam], score[np.arange(len(x)), fam], lang, margin


def contests(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def decide(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(winner, margin of its closest contest) of each row of scores, one column a contest, positive for its first side.

    Most contests won; then the greatest sum of margins; then the first in order.
    """
    wins, total, least = np.zeros((len(score), n)), np.zeros((len(score), n)), np.full((len(score), n), np.inf)
    for s, (i, j) in zip(score.T, contests(n)):
        wins[:, i] += s >= 0
        wins[:, j] += s < 0
        total[:, i] += s
        total[:, j] -= s
        least[:, i], least[:, j] = np.minimum(least[:, i], s), np.minimum(least[:, j], -s)
    top = wins == wins.max(1, keepdims=True)
    best = np.where(top, total, -np.inf).argmax(1)
    return best, np.where(np.isinf(least), 1.0, least)[np.arange(len(score)), best]


def machines(x: np.ndarray, labels: list[str], languages: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rows) of each machine: those of the families, one where there are two, then each family's contests. Zeros where a side has no row."""
    lang = np.array(labels, object)
    member = [np.isin(lang, names) for names in languages.values()]
    every = np.ones(len(lang), bool)
    sides = [(every, g) for g in (member[:1] if len(member) == 2 else member if len(member) > 2 else [])]
    for names in languages.values():
        sides += [((lang == names[i]) | (lang == names[j]), lang == names[i]) for i, j in contests(len(names))]
    weights, size = np.zeros((len(sides), x.shape[1] + 1)), np.zeros(len(sides))
    for k, (rows, first) in enumerate(sides):
        y = first[rows]
        if y.any() and not y.all():
            weights[k], size[k] = svm(x[rows], np.where(y, 1, -1).astype(np.float32)), len(y)
    return weights, size


def assembled(weights: np.ndarray, languages: dict[str, list[str]]) -> Model:
    weights = weights.astype(np.float32)
    if len(languages) == 1:  # nothing to tell apart: the margin is 1
        family, at = np.append(np.zeros(DIMENSIONS), 1.0)[:, None].astype(np.float32), 0
    elif len(languages) == 2:  # each is the other's rest
        family, at = np.stack([weights[0], -weights[0]], 1), 1
    else:
        family, at = weights[: len(languages)].T, len(languages)
    within = []
    for names in languages.values():
        n = len(contests(len(names)))
        within.append(weights[at : at + n].T)
        at += n
    return Model(list(languages), family, list(languages.values()), within)


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    """Fits on all labelled documents.

    The hash of doc_id deals them into blocks of about `sample` documents a language. Machines are fitted on each block by one task, and the model has their
    means, in which each row counts the same: of a small table, which makes one block, it is the machine of all rows. Copies of a row (same doc_id, lang and vector) count once.
    Known trigrams and the least share of them are also taken from all labelled documents.

    Two scans of the texts: the first makes vectors, about as large as the texts when compressed, which are shuffled by block, and counts
    in how many documents each trigram occurs; the second gets the shares of known trigrams. The driver gets sums of weights and the
    list of known trigrams, whatever the input's size.
    """
    known = docs.filter(F.col("lang").isin([g for names in families.values() for g in names]) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, x binary, g int, n bigint"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, np.ndarray] = {}
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for k in range(0, batch.num_rows, 256):
                part, held = batch.slice(k, 256), []
                x, letters, *_ = _features(part.column("text"), None, held)
                names = np.array(part.column("lang").to_pylist(), object)
                both = distinct(np.concatenate([np.zeros(0, np.int64), *held]))
                lang = names[both // TABLE]
                for g in set(names):
                    place, n = np.unique(both[lang == g] % TABLE, return_counts=True)
                    count.setdefault(g, np.zeros(TABLE, np.int64))[place] += n
                ok = np.flatnonzero(letters > 0)
                m = len(ok)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ok)), part.column("lang").take(pa.array(ok)), pa.array([_packed(x[i]) for i in ok], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], ["doc_id", "lang", "x", "g", "n"])
        for g, n in count.items():
            place = np.flatnonzero(n)
            m = len(place)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, doc_type), pa.array([g] * m, pa.string()), pa.nulls(m, pa.binary()), pa.array(place.astype(np.int32)), pa.array(n[place])], ["doc_id", "lang", "x", "g", "n"])

    rows = shared_table(spark, known.mapInArrow(vectors, kind), "vectors")
    number = {r.lang: r.n for r in rows.filter("x is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = {f: [g for g in names if g in number] for f, names in families.items()}
    languages = {f: names for f, names in languages.items() if names}
    if not languages:
        return None
    blocks = max(1, round(sum(number.values()) / (sample * len(number))))

    def committee(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in whole(batches, ("block",)):
            block = t.column("block").to_numpy()
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for s, e in zip(cut.tolist(), np.append(cut[1:], len(block)).tolist()):
                own = t.slice(s, e - s).to_pydict()
                one = dict.fromkeys(zip(own["doc_id"], own["lang"], own["x"]))
                w, n = machines(np.stack([_unpacked(x) for _, _, x in one]), [g for _, g, _ in one], languages)
                part = np.hstack([w * n[:, None], n[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["w"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for w in batch.column("w").to_pylist():
                total = np.frombuffer(w) if total is None else total + np.frombuffer(w)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["w"])

    dealt = rows.filter("x is not null").select("doc_id", "lang", "x", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
    parts = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = dealt.repartition(parts, "block").sortWithinPartitions("block", "lang", "doc_id").mapInArrow(committee, "w binary").repartition(8).mapInArrow(added, "w binary").toArrow()
    total = sum(np.frombuffer(w).reshape(-1, DIMENSIONS + 2) for w in sums.column("w").to_pylist())
    model = assembled(total[:, :-1] / np.maximum(total[:, -1:], 1), languages)

    table = np.zeros(TABLE, bool)
    share = F.lit(0.0)
    for g, n in number.items():
        share = F.when(F.col("lang") == g, F.lit(1.0 / n)).otherwise(share)
    places = rows.filter("g is not null").groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * share).alias("share"))
    table[places.filter((F.col("n") > 1) & (F.col("share") >= SEEN - 1e-9)).select("g").toArrow().column("g").to_numpy()] = True
    free(spark, rows)
    model.table = np.packbits(table)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, n = known_share(batch.column("text").slice(k, 256), table)
                yield pa.RecordBatch.from_arrays([pa.array((part + NOISE / np.sqrt(np.maximum(n, 1)))[n > 0])], ["v"])

    own = shared_table(spark, known.select("text").mapInArrow(shares, "v double"), "shares")
    least = quantile(own, QUANTILE)
    if least is not None:
        model.known = KNOWN * least
    free(spark, own)
    return model


def quantile(values: DataFrame, q: float) -> float | None:
    """The exact quantile of column v, interpolated between two values: they are counted by cells, and only those of the cells in question are looked at."""
    cell = F.floor(F.col("v") * 4096)
    cells = sorted((r.c, r.n) for r in values.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not cells:
        return None
    upto = np.cumsum([n for _, n in cells])
    at = (int(upto[-1]) - 1) * q
    lo, hi = int(at), min(int(at) + 1, int(upto[-1]) - 1)
    i, j = (int(np.searchsorted(upto, k, "right")) for k in (lo, hi))
    few = sorted((r.v, r.n) for r in values.filter(cell.between(cells[i][0], cells[j][0])).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect())
    end = np.cumsum([n for _, n in few]) + (int(upto[i]) - cells[i][1])
    a, b = (few[int(np.searchsorted(end, k, "right"))][0] for k in (lo, hi))
    return a + (b - a) * (at - lo)


OUT = "family string, language string, family_margin double, margin double, known double, accepted boolean"


def _predictor(model: Model | None, known: float | None, text: str):
    names = [x.split()[0] for x in OUT.split(", ")]

    def predict(column: pa.Array) -> list[pa.Array]:
        n = len(column)
        if model is None:
            return [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *[pa.nulls(n, pa.float64())] * 3, pa.array(np.zeros(n, bool))]
        x, letters, share, three = _features(column, np.unpackbits(model.table).astype(bool) if model.table is not None else None)
        fam, fm, lang, m = model.predict(x)
        dark = letters == 0
        ok = ~dark & (share + NOISE / np.sqrt(np.maximum(three, 1)) >= (model.known if known is None else known))
        return [pa.array(fam, pa.string(), mask=dark), pa.array(lang, pa.string(), mask=dark), pa.array(fm.astype(float), mask=dark), pa.array(m.astype(float), mask=dark), pa.array(share, mask=dark), pa.array(ok)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                old = [(c, f) for c, f in zip(part.columns, part.schema.names) if f != text]
                yield pa.RecordBatch.from_arrays([c for c, _ in old] + predict(part.column(part.schema.get_field_index(text))), [f for _, f in old] + [f"__{x}" for x in names])

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, sample: int = SAMPLE, known: float | None = None, families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """docs with __family, __language, __family_margin, __margin, __known (the share of its trigrams that are known) and __accepted.

    `families` names the languages of each family. The label `lang` is only looked at to fit the machines; the prediction is made from the whole text:
    the family of the greatest score, then the language of that family that wins most of the contests of two; __margin is that of its closest
    contest, 1 where it has none. Rejected (__accepted false) are texts without a letter, null and empty ones among them, whose other new columns are
    null, and texts of another language: too few of their trigrams are known (SEEN). How few is
    measured on all labelled documents (KNOWN, QUANTILE, NOISE), or given as `known`. A text that is too
    short for a trigram is accepted. Without labelled rows there is no model: all rows
    are rejected with nulls. Repeated rows each get the same result; ties go by the sum of margins, then to the first family and language in
    the order of `families`. Other columns pass unchanged; those named like the new ones are replaced.
    """
    model = model or train(spark, docs, sample, families)
    keep = [c for c in docs.columns if c.lower() not in {"__family", "__language", "__family_margin", "__margin", "__known", "__accepted"}]
    text = fresh(docs, "__text")
    new = ", ".join(f"__{x.strip()}" for x in OUT.split(","))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(_predictor(model, known, text), fields + new)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, family, language, family_margin, margin, known, accepted) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = identify(spark, docs)
    return out.select("doc_id", *[F.col(f"__{x.split()[0]}").alias(x.split()[0]) for x in OUT.split(", ")])
