"""Near-duplicates by 256-bit SimHash signatures and random bit sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh, shared_table, whole
from ._text import U, Words, mix, slices

BITS = 256
WORDS = [f"w{k}" for k in range(BITS // 64)]
#: Coordinates that make a key, at least, and the rows that a bucket has on average, at most: more rows make longer keys.
SAMPLED = 12
BUCKET = 1024
DISTANCE = 48
#: Chance that two signatures at DISTANCE meet in a table; it sets the number of tables.
RECALL = 0.9
#: A bucket of more rows is cut into chunks before its rows are brought together, each two of which meet in a part of less than twice as many rows.
SPLIT = 16 * BUCKET
#: Links of a task that are held before they are reduced to stars.
HELD = 1 << 20


def layout(n: int) -> tuple[int, int]:
    """(coordinates of a key, tables) for n signatures. A pair at DISTANCE agrees on all coordinates of a key with the chance (1 - DISTANCE / BITS) ** coordinates."""
    bits = max(SAMPLED, math.ceil(math.log2(max(1, n / BUCKET))))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DISTANCE / BITS) ** bits))


def signatures(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes, and the count of features, of each text: its word pairs, or its only word."""
    n = len(words.first) - 1
    count, text = np.diff(words.first), words.text_of()
    h = words.hash
    pair = np.zeros(len(h), bool)
    pair[:-1] = text[:-1] == text[1:]
    features = mix(h * U(3) + np.where(pair, np.append(h[1:], U(0))[: len(h)], U(0)))
    use = pair | (count[text] == 1)
    features, text = features[use], text[use]
    sizes = np.bincount(text, minlength=n)
    sums = np.zeros((n, BITS), np.float32)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
    small = max(1, n * 256)
    for k in range(BITS // 64):
        raw = mix(features, k + 1).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            seen = np.bincount(text * 256 + raw[:, b], minlength=small).reshape(-1, 256)[:n] if n else np.zeros((0, 256))
            at = (k * 8 + b) * 8
            sums[:, at : at + 8] = seen.astype(np.float32) @ table
    tie = np.unpackbits(mix(np.arange(BITS // 64, dtype=U), 99).view(np.uint8)).astype(bool)
    twice = 2 * sums - sizes[:, None]
    return np.packbits((twice > 0) | ((twice == 0) & tie), axis=1), sizes


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sig, sizes = signatures(Words.of(part.column("text")))
            ok = np.flatnonzero(sizes)
            words = np.ascontiguousarray(sig[ok]).view(np.int64).reshape(len(ok), -1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ok)), *[pa.array(words[:, k]) for k in range(len(WORDS))]], ["id", *WORDS])


def sampled(bits: int, tables: int) -> np.ndarray:
    """The coordinates of each table's key."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(tables)])


def _words(batch) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1)


def _values(words: np.ndarray, orders: np.ndarray) -> Iterator[np.ndarray]:
    """The key of each row, one table after the other."""
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    for t, order in enumerate(orders):
        yield bits[:, order].astype(np.int64) @ (1 << np.arange(len(order), dtype=np.int64)) + (t << len(order))


def _sizes(orders: np.ndarray):
    """Rows of each bucket, as far as a task has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(sizes), minlength=len(k)).astype(np.int64)

        for batch in batches:
            for key in _values(_words(batch), orders):
                k, n = np.unique(key, return_counts=True)
                keys.append(k)
                sizes.append(n)
                held += len(k)
            if held > 1 << 21:
                k, n = merged()
                keys, sizes, held = [k], [n], len(k)
                if held > 1 << 20:  # more than a task should hold; Spark adds them up
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    keys, sizes, held = [k[:0]], [n[:0]], 0
        k, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])

    return run


KEYED = "key bigint, part bigint, half int, id bigint, " + ", ".join(f"{w} bigint" for w in WORDS)


def _keys(orders: np.ndarray, chunks: dict[int, int]):
    """A row for each table. chunks: for each bucket that is cut beforehand the number of its chunks; a row goes to the parts of its chunk with each one.

    half: 0 in the part of a chunk with itself, 1 or 2 for the two chunks of another part, where only rows of different halves are compared.
    """
    names = [x.split()[0] for x in KEYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.array(sorted(chunks), np.int64)
        for batch in batches:
            ids, words = batch.column("id").to_numpy(), _words(batch)

            def rows(at: np.ndarray, key: np.ndarray, part: np.ndarray, half: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, part, half.astype(np.int32), ids[at], *words[at].T)], names)

            for key in _values(words, orders):
                cut = np.isin(key, large)
                at = np.flatnonzero(~cut)
                yield rows(at, key[at], np.zeros(len(at), np.int64), np.zeros(len(at)))
                for k in np.unique(key[cut]):
                    at, c = np.flatnonzero(key == k), chunks[int(k)]
                    own = (mix(ids[at].view(U), 7) % U(c)).astype(np.int64)
                    for other in range(c):
                        part = np.minimum(own, other) * c + np.maximum(own, other) + 1
                        yield rows(at, key[at], part, np.where(own == other, 0, np.where(own < other, 1, 2)))

    return run


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the graph of edges a-b over positions: each position in a component, and its least one."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return moved, label[moved]


def near(words: np.ndarray, ids: np.ndarray, group: np.ndarray, half: np.ndarray, earlier: np.ndarray, distance: int = DISTANCE, held_at_most: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, links): edges between positions of rows within `distance` of the same group, one star for each set of linked ones, and the links of each row.

    All pairs of a group are compared, however many rows it has, but for those of the same half. Links are counted where no mask of
    `earlier` (those of the tables before) has the two rows in one bucket, so that each pair counts once in all.
    """
    n = len(ids)
    rank = np.lexsort((ids, group))
    g, w, h = group[rank], np.ascontiguousarray(words[rank]).view(U), half[rank]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if n else np.zeros(0, int)
    left = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n) - 1
    links = np.zeros(n, np.int64)
    a_all, b_all, held, at, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, np.flatnonzero(left > 0), 1
    while len(at):
        x = at if not h.any() else at[(h[at] == 0) | (h[at] != h[at + s])]
        far = np.zeros(len(x), np.uint16)
        for k in range(w.shape[1]):
            far = far + np.bitwise_count(w[x, k] ^ w[x + s, k])
            ok = far <= distance
            x, far = x[ok], far[ok]
        if len(x):
            a_all.append(x)
            b_all.append(x + s)
            held += len(x)
            new = x
            for mask in earlier:
                same = np.ones(len(new), bool)
                for k in range(w.shape[1]):
                    same &= (w[new, k] ^ w[new + s, k]) & mask[k] == 0
                new = new[~same]
            links[new] += 1
            links[new + s] += 1
            if held > held_at_most:
                moved, root = _stars(ids, np.concatenate(a_all), np.concatenate(b_all))
                a_all, b_all, held = [moved], [root], len(moved)
        s += 1
        at = at[left[at] >= s]
    moved, root = _stars(ids, np.concatenate(a_all), np.concatenate(b_all))
    back = np.zeros(n, np.int64)
    back[rank] = links
    return rank[moved], rank[root], back


def _masks(orders: np.ndarray) -> np.ndarray:
    """For each table the words in which its coordinates are set."""
    bits = np.zeros((len(orders), BITS), np.uint8)
    for t, order in enumerate(orders):
        bits[t, order] = 1
    return np.packbits(bits, axis=1).view(U)


def _linker(orders: np.ndarray):
    """(a, b, links): edges, and for each row of a bucket with links, a row of a = b and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(orders)
        for t in whole(batches, ("key", "part")):
            key, ids, half, words = t.column("key").to_numpy(), t.column("id").to_numpy(), t.column("half").to_numpy(), _words(t)
            group = mix(key.view(U) + mix(t.column("part").to_numpy().view(U), 5), 6)
            table = key >> orders.shape[1]
            out_a, out_b, out_n = [], [], []
            for k in np.unique(table):
                at = np.flatnonzero(table == k)
                a, b, links = near(words[at], ids[at], group[at], half[at], masks[:k])
                own = np.flatnonzero(links)
                out_a += [ids[at[a]], ids[at[own]]]
                out_b += [ids[at[b]], ids[at[own]]]
                out_n += [np.zeros(len(a), np.int64), links[own]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)], ["a", "b", "links"])

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges (a, b) but the roots; root is the least of its component.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the
    longest path; each round is written to the shared folder.
    """
    e = shared_table(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = shared_table(spark, new, "edges")
        same = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        e = new
        if same:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _links(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures (id, words), the first document of each and their number (words, first, n), edges (a, b) and links (first, links)."""
    text = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = shared_table(spark, text.mapInArrow(_sign, "id bigint, " + ", ".join(f"{w} bigint" for w in WORDS)), "signatures").distinct()
    firsts = shared_table(spark, sig.groupBy(*WORDS).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "firsts")
    equal = sig.join(firsts.filter("n > 1").select(*WORDS, F.col("id").alias("b")), WORDS).filter("id <> b").select(F.col("id").alias("a"), "b")
    orders = sampled(*layout(firsts.count()))
    sizes = firsts.mapInArrow(_sizes(orders), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > SPLIT)
    chunks = {r.key: r.n // SPLIT + 1 for r in sizes.collect()}
    keyed = firsts.select("id", *WORDS).mapInArrow(_keys(orders, chunks), KEYED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_linker(orders), "a bigint, b bigint, links bigint")
    found = shared_table(spark, found, "links")
    links = found.filter("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
    return sig, firsts.withColumnRenamed("id", "first"), equal.union(found.filter("a <> b").select("a", "b")), links


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links) for each document: its group's least doc_id, how many other documents have its signature, and how many other signatures are linked to its own.

    Signature: SimHash of the word pairs. Two signatures are linked where they differ in at most DISTANCE of BITS bits and agree on
    the sampled coordinates of one of the tables; groups are the connected components. Documents of equal signature are one in the tables, so
    copies in thousands make no more rows than there are copies. A key has SAMPLED coordinates, and
    more where buckets would have over BUCKET rows on average; the tables are then so many that a pair at DISTANCE meets with the chance RECALL at any
    size of the input, nearer ones with a greater one (`layout`). Within a bucket all pairs are compared, and one star for each group leaves it. Buckets of over
    SPLIT rows, as many near copies make them, are cut into chunks before their rows are brought together, and each two chunks meet in
    one part, so no pair is lost and no task holds 2 SPLIT rows or more of a bucket; their comparisons grow with the square of the rows.

    Documents with a null id are left out; those with a null text or no word are alone in their class. Repeated rows and
    rows of the same doc_id are one document; where their texts differ each of them links it, and copies and links are sums over them. Empty table: empty.
    Other columns are not looked at. doc_id must be an integer.

    Shuffles: 60 bytes a distinct signature and table, as many times as a large bucket has chunks, and the edges. Tasks stream over buckets.
    """
    sig, firsts, edges, links = _links(spark, docs)
    roots = components(spark, edges)
    per = sig.join(firsts, WORDS).join(links, "first", "left").groupBy("id").agg(F.sum(F.col("n") - 1).alias("copies"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id")).distinct()
    out = ids.join(roots, "id", "left").join(per, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("copies", "links")])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the documents that have another one's doc_id as their class (see near_duplicates); rows with a null id stay."""
    name = fresh(docs, "__gone")
    _, _, edges, _ = _links(spark, docs)
    gone = shared_table(spark, components(spark, edges).select(F.col("id").alias(name)), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
