"""Exact neighbours against all distances."""

import numpy as np

from strataloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim string"


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24)) * 3
    x = (centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 24)) * 0.3).astype(np.float32)
    x[390:395] = x[0]  # ties
    rows = [(i, v.tolist(), None, "d") for i, v in enumerate(x)]
    rows += [(7, rows[7][1], None, "d"), (1000, None, None, "d"), (None, rows[0][1], None, "d"), (1001, [1.0, None], None, "d"), (1002, [float("nan")] * 24, None, "d"), (1003, [1.0, 2.0], None, "d"), (1004, [1.0, 2.5], None, "d"), (1005, [], None, "d")]
    got = {}
    for r in topk.top_k(spark, spark.createDataFrame(rows, SCHEMA), k=10, block=64).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbor_id, r.distance)
    d = np.sqrt(np.square(x[:, None].astype(float) - x[None].astype(float)).sum(2))
    for i in range(400):
        order = [j for j in sorted(range(400), key=lambda j: (d[i, j], j)) if j != i][:10]
        assert [got[i][r][0] for r in range(1, 11)] == order
        assert np.allclose([got[i][r][1] for r in range(1, 11)], d[i, order])
    assert got[1003] == {1: (1004, 0.5)} and got[1004] == {1: (1003, 0.5)}
    assert not {1000, 1001, 1002, 1005} & set(got)


def test_empty(spark):
    assert topk.top_k(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 64)), rng.normal(size=(200, 64))
    exact = np.square(x - y).sum(1)
    last = np.zeros(200)
    for s in topk.LEVELS:
        b = np.square(topk.segment_stats(x, s) - topk.segment_stats(y, s)).sum(1)
        assert (b <= exact + 1e-9).all() and (b >= last - 1e-9).all()
        last = b


def test_some_queries_against_all_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist(), None, "d") for i, v in enumerate(x)], SCHEMA)
    every = {(r.vec_id, r.rank, r.neighbor_id) for r in topk.top_k(spark, df, block=16).collect()}
    got = {(r.vec_id, r.rank, r.neighbor_id) for r in topk.top_k(spark, df, block=16, queries=F.col("vec_id") % 50 == 0).collect()}
    assert got == {r for r in every if r[0] % 50 == 0} and len(got) == 180


def test_larger_boxes_lose_nothing():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(640, 32)) + np.repeat(rng.normal(size=(40, 32)) * 4, 16, 0)
    parts = [(x[i : i + 16], np.arange(i, i + 16), [topk.segment_stats(x[i : i + 16], s) for s in topk.LEVELS]) for i in range(0, 640, 16)]
    boxes = tuple(np.stack([f(p[2][topk.BOXES], 0) for p in parts]) for f in (np.min, np.max))
    d = np.square(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    read = []
    for wide in (1, 7, 64):
        got, _ = topk.search_block(x[:32], np.arange(32), boxes, lambda j: read.append(j) or parts[j], 5, wide)
        assert np.allclose(got, np.sort(d[:32], 1)[:, :5])
    assert len(read) < 3 * 40  # some blocks are never read
