"""Exact top-k search by segment statistics of several resolutions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import posix, shared_dir, shared_table

K = 10
BLOCK = 1024
#: Queries of a task.
QUERIES = 128
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (2, 8, 32)
#: The level whose statistics make the boxes of blocks; blocks of a larger box.
BOXES, WIDE = 1, 64
#: Relative slack of the lower bounds for their own rounding.
SLACK = 1e-9


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """(n, 2 * segments): mean and deviation of each segment, times the root of its length.

    The squared distance of two such rows is at most that of the vectors: within a segment of length m,
    |x - y|^2 >= m (mean difference^2 + deviation difference^2).
    """
    edges = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    size = np.diff(edges)
    mean = np.stack([x[:, a:b].mean(1) for a, b in zip(edges, edges[1:])], 1) if x.shape[1] else np.zeros((len(x), 1))
    dev = np.stack([x[:, a:b].std(1) for a, b in zip(edges, edges[1:])], 1) if x.shape[1] else np.zeros((len(x), 1))
    return np.concatenate([mean, dev], 1) * np.sqrt(np.maximum(np.concatenate([size, size]), 1))


def box_bound(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(queries, boxes): the least squared distance of each query's statistics to any point of each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, k] - q[:, k, None], q[:, k, None] - high[None, :, k])) ** 2
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _merge(best_d: np.ndarray, best_i: np.ndarray, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Adds exact distances of (rows[j], ids[j]) to the best lists; ties go to the least id."""
    if not len(rows):
        return
    k = best_d.shape[1]
    some = np.unique(rows)
    row = np.concatenate([np.repeat(some, k), rows])
    dist, who = np.concatenate([best_d[some].ravel(), d]), np.concatenate([best_i[some].ravel(), ids])
    order = np.lexsort((who, dist, row))
    row, dist, who = row[order], dist[order], who[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    top = first[:, None] + np.arange(k)  # every list has k entries at least
    best_d[some], best_i[some] = dist[top], who[top]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(1)


def search_block(q: np.ndarray, q_ids: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], load, k: int = K, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids of the k nearest other vectors of each query.

    boxes: least and greatest statistics of the BOXES level of each block; load(j): (vectors, ids, statistics of each level) of block j. `wide` blocks that follow each other
    make a larger box. Larger boxes come in order of their bounds, then the blocks of each; the search ends where
    no query's k-th distance reaches the next larger box.
    """
    n = len(q)
    stats = [*[segment_stats(q, s) for s in LEVELS], q]  # at last segments of one component, as products of matrices
    own = stats[BOXES]
    best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    low, high = boxes
    first = np.arange(0, len(low), wide)
    above = box_bound(np.minimum.reduceat(low, first, 0), np.maximum.reduceat(high, first, 0), own).min(0) if len(low) else np.zeros(0)
    for g in np.argsort(above, kind="stable"):
        if above[g] > (best_d[:, -1] * (1 + SLACK) + SLACK).max():
            break
        lo, hi = first[g], min(len(low), first[g] + wide)
        bound = box_bound(np.asarray(low[lo:hi]), np.asarray(high[lo:hi]), own)
        for j in np.argsort(bound.min(0), kind="stable"):
            rows = np.flatnonzero(bound[:, j] <= best_d[:, -1] * (1 + SLACK) + SLACK)
            if not len(rows):
                continue
            x, ids, levels = load(int(lo + j))
            for part in np.array_split(rows, -(-len(rows) // 256)):
                _search_part(q, q_ids, stats, part, x, ids, [*levels, x], best_d, best_i)
    return best_d, best_i


def _search_part(q, q_ids, stats, part, x, ids, levels, best_d, best_i) -> None:
    """Compares the queries `part` with one block: by ever finer statistics, then by the vectors that are left."""
    k = best_d.shape[1]
    other = q_ids[part][:, None] != ids[None, :]

    def exact(a: np.ndarray, b: np.ndarray) -> None:
        step = 1 << 16
        d = np.concatenate([_exact(q[part[a[i : i + step]]], x[b[i : i + step]]) for i in range(0, len(a), step)]) if len(a) else np.zeros(0)
        ok = d <= best_d[part[a], -1]
        _merge(best_d, best_i, part[a[ok]], d[ok], ids[b[ok]])

    left = other
    if np.isinf(best_d[part, -1]).any():  # lists that aren't full yet: first those that are likely the nearest
        guess = np.where(other, _pairwise(stats[-1][part], levels[-1]), np.inf)
        n = min(k, guess.shape[1])
        b = np.argpartition(guess, n - 1, axis=1)[:, :n]
        a = np.repeat(np.arange(len(part)), n)
        ok = other[a, b.ravel()]
        exact(a[ok], b.ravel()[ok])
        left = other.copy()
        left[a, b.ravel()] = False
    limit = best_d[part, -1] * (1 + SLACK) + SLACK
    for level in range(len(levels)):
        share = np.count_nonzero(left) / max(1, left.size)
        if share < 0.02:
            a, b = np.nonzero(left)
            ok = _exact(stats[level][part[a]], levels[level][b]) <= limit[a]
            left = np.zeros_like(left)
            left[a[ok], b[ok]] = True
        else:
            left = left & (_pairwise(stats[level][part], levels[level]) <= limit[:, None])
    exact(*np.nonzero(left))


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, a little low so that rounding never drops a neighbour."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return d - 1e-12 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :])


def _curve(stats: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = 12) -> np.ndarray:
    """Places of coarse statistics on a Morton curve through the box from low to high."""
    cell = np.clip((stats - low) / np.where(high > low, high - low, 1), 0, 1) * ((1 << bits) - 1)
    cell = cell.astype(np.int64)
    out = np.zeros(len(stats), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(cell.shape[1]):
            out = out << 1 | (cell[:, d] >> b & 1)
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the vectors of a batch."""
    flat = batch.column("__x")
    lengths = np.diff(flat.offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, _vectors(flat.take(pa.array(at)))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest coarse statistics of each length of vector."""
    for batch in batches:
        for d, _, x in _by_length(batch):
            s = segment_stats(x, LEVELS[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.shape[1], d, np.int32)), pa.array(np.arange(s.shape[1], dtype=np.int32)), pa.array(s.min(0)), pa.array(s.max(0))], ["dim", "at", "low", "high"])


def _ordered(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, key, ids, x, is_query): vectors of one length in a row each, near each other in their coarse statistics; at most `size` a row."""
    ends: dict[int, tuple[list, list]] = {}
    for r in vectors.mapInArrow(_ends, "dim int, at int, low double, high double").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "at").collect():
        low, high = ends.setdefault(r.dim, ([], []))
        low.append(r.low)
        high.append(r.high)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dim = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for d, at, x in _by_length(batch):
                out[at], dim[at] = _curve(segment_stats(x, LEVELS[0]), *(np.array(e) for e in ends[d])), d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(out)], ["__id", "__x", "__q", "dim", "key"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(dims))):
                for i in range(s, e, size):
                    part = batch.slice(i, min(size, e - i))
                    ids, x, q = part.column("__id").to_numpy(), _vectors(part.column("__x")), part.column("__q").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dims[s])], pa.int32()), pa.array([part.column("key")[0].as_py()]), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, x.astype(np.float64), q.astype(bool))]], ["dim", "key", "ids", "x", "is_query"])

    keyed = vectors.mapInArrow(key, "__id bigint, __x array<double>, __q boolean, dim int, key bigint")
    return keyed.repartitionByRange("dim", "key", "__id").sortWithinPartitions("dim", "key", "__id").mapInArrow(block, "dim int, key bigint, ids binary, x binary, is_query binary")


def top_k(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK, queries=None) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): for every query the k nearest other vectors by Euclidean distance, exactly.

    Queries are the rows for which the column `queries` holds, all without it; they are compared with all rows. Ties go to the least id. Rows with a null id, a null or empty vector or a null or non-finite component are neither queries nor
    neighbours. Vectors are compared with those of their own length. Repeated rows (same id and
    vector) count once; a vector isn't a neighbour of another one with its id. With fewer than k others the list is
    shorter. Empty table: empty. Other columns are not looked at. Ids must be integers.

    Vectors are range-partitioned along a Morton curve over their coarsest statistics into blocks of `block` rows, which are written to
    the shared folder as files that tasks map into memory. The boxes of the blocks' statistics and their names are put in
    the order of the curve into two more files, which tasks map too. A
    task takes up to QUERIES queries of one block, orders boxes of WIDE blocks, then the blocks, by their lower bounds and stops where no query can gain; in a
    block it drops pairs by ever finer statistics before it computes distances. Nothing but the vectors is
    shuffled, once.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    clean = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("__id"), x.alias("__x"), asked.alias("__q"))
    clean = clean.filter((F.size("__x") > 0) & ~F.exists("__x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).distinct()
    folder = posix(f"{shared_dir(spark)}/vectors-{os.urandom(6).hex()}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for dim, key, ids, raw, q in zip(*(batch.column(n).to_pylist() for n in ("dim", "key", "ids", "x", "is_query"))):
                x = np.frombuffer(raw, np.float64).reshape(-1, dim)
                who = np.frombuffer(ids, np.int64)
                name = f"{os.urandom(12).hex()}"
                levels = [segment_stats(x, s) for s in LEVELS]
                np.save(f"{folder}/{name}.npy", np.concatenate([who.view(np.float64)[:, None], np.frombuffer(q, bool)[:, None].astype(np.float64), x, *levels], 1))
                box = levels[BOXES]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([dim], pa.int32()), pa.array([key]), pa.array([int(np.frombuffer(q, bool).sum())]), pa.array([box.min(0)], pa.list_(pa.float64())), pa.array([box.max(0)], pa.list_(pa.float64()))], ["name", "dim", "key", "queries", "low", "high"])

    # the table lists the files of the attempts that were committed; those of lost ones are never read
    blocks = shared_table(spark, _ordered(clean, block).mapInArrow(write, "name string, dim int, key bigint, queries bigint, low array<double>, high array<double>"), "boxes")
    listed = posix(blocks.inputFiles()[0].rpartition("/")[0]) if blocks.inputFiles() else None

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        for batch in batches:
            for dim in batch.column("dim").to_pylist():
                t = ds.dataset(listed, format="parquet").to_table(columns=["name", "key", "low", "high"], filter=ds.field("dim") == dim).sort_by([("key", "ascending"), ("name", "ascending")]).combine_chunks()
                name = f"{folder}/{os.urandom(12).hex()}"
                np.save(f"{name}.box.npy", np.stack([_vectors(t.column(c).combine_chunks()) for c in ("low", "high")]))
                np.save(f"{name}.name.npy", np.array(t.column("name").to_pylist(), "S24"))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([name])], ["dim", "path"])

    indexes = {r.dim: r.path for r in shared_table(spark, blocks.select("dim").distinct().mapInArrow(index, "dim int, path string"), "index").collect()}

    def load(name: str, dim: int):
        m = np.load(f"{folder}/{name}.npy", mmap_mode="r")
        levels, at = [], 2 + dim
        for s in LEVELS:
            wide = 2 * max(1, min(s, max(1, dim)))
            levels.append(np.asarray(m[:, at : at + wide]))
            at += wide
        return np.asarray(m[:, 2 : 2 + dim]), np.ascontiguousarray(m[:, 0]).view(np.int64), levels, m[:, 1] > 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, dim, start in zip(*(batch.column(n).to_pylist() for n in ("name", "dim", "start"))):
                if dim not in have:
                    have[dim] = tuple(np.load(f"{indexes[dim]}.{x}.npy", mmap_mode="r") for x in ("box", "name"))
                boxes, names = have[dim]
                q, ids, _, asked = load(name, dim)
                at = np.flatnonzero(asked)[start : start + QUERIES]
                d, who = search_block(q[at], ids[at], (boxes[0], boxes[1]), lambda j: load(names[j].decode(), dim)[:3], k)
                r, c = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][r]), pa.array(who[r, c]), pa.array((c + 1).astype(np.int32)), pa.array(np.sqrt(d[r, c]))], ["vec_id", "neighbor_id", "rank", "distance"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = blocks.filter("queries > 0").select("name", "dim", F.explode(F.sequence(F.lit(0), F.col("queries") - 1, F.lit(QUERIES))).alias("start"))
    return asks.repartition(4 * n, "name", "start").mapInArrow(search, "vec_id bigint, neighbor_id bigint, rank int, distance double")


#: Of the query's table each row whose id is divisible by this is a query.
EACH = 50


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest of all rows for every row whose id is divisible by EACH."""
    out = top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), queries=F.col("vec_id") % EACH == 0)
    return out.withColumn("distance", F.round("distance", 6))


OP4_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, neighbor_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(dist, 6) AS distance
FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY dist, neighbor_id) QUALIFY row_number() OVER w <= 10
"""
