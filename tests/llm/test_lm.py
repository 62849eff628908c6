"""The trie against a brute-force model in dictionaries."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import lm
from strataloom.llm._text import Words

TEXTS = ["the cat sat on the mat", "the cat ran", "", None, "a b", "The cat, sat on the mat!", "Zoë ß 北京", "x " * 5000, "..."]


def split(text):
    w = Words.of(pa.array([text or ""]))
    return lm.codes(w).tolist()


class Brute:
    def __init__(self, texts):
        self.n = [Counter(), Counter(), Counter()]
        for t in texts:
            w = split(t)
            for i, x in enumerate(w):
                v = w[i - 1] if i else 0
                self.n[0][x] += 1
                self.n[1][v, x] += 1
                if i:
                    self.n[2][w[i - 2] if i > 1 else 0, v, x] += 1
        self.d = [lm.discount(sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())) for n in self.n]
        self.running = sum(self.n[0].values())
        self.total, self.kinds = Counter(), Counter()
        for n in self.n[1:]:
            for g, c in n.items():
                self.total[g[:-1]] += c
                self.kinds[g[:-1]] += 1

    def p(self, u, v, w):
        words = len(self.n[0]) + 1
        p = max(self.n[0][w] - self.d[0], 0) / self.running + self.d[0] * (words - 1) / self.running / words
        for ctx, k in (((v,), 1), ((u, v), 2)):
            if (k == 1 or v) and self.total[ctx]:
                p = max(self.n[k][*ctx, w] - self.d[k], 0) / self.total[ctx] + self.d[k] * self.kinds[ctx] / self.total[ctx] * p
        return p

    def log_prob(self, text):
        w = [0, 0, *split(text)]
        return sum(math.log10(self.p(*w[i - 2 : i + 1])) for i in range(2, len(w)))


def test_counts_of_pieces_add_up(tmp_path):
    rng = np.random.default_rng(2)
    whole_ctx, whole_w, names, at, size = [], [], [], [], []
    for k in range(3):
        ctx, w = rng.integers(0, 9, 400).astype(np.uint64), rng.integers(1, 9, 400).astype(np.uint64)
        data = lm._pack_counts(*lm.counted(3, ctx, w))
        (tmp_path / str(k)).write_bytes(b"xx" + data)
        whole_ctx.append(ctx), whole_w.append(w), names.append(str(tmp_path / str(k))), at.append(2), size.append(len(data))
    got = lm.merged(3, names, at, size)
    want = lm.counted(3, np.concatenate(whole_ctx), np.concatenate(whole_w))
    assert all((a == b).all() for a, b in zip(got, want)) and got[2].sum() == 1200


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, __n_words string, __text string")


@pytest.mark.parametrize("shard", [lm.SHARD, 700])
def test_scores_match_brute_force(spark, shard):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, range(60, 0, -1), k=rng.randrange(1, 60))) for _ in range(80)]
    trie = lm.train(spark, frame(spark, texts).select("doc_id", "text"), shard)
    assert shard == lm.SHARD or len(trie.three) > 4
    model = Brute(texts)
    queries = [*texts, "the dog sat", "never seen", "the", "w1 w2 w3 unseen w4 w5 w6", "long " + "the cat " * 100_000]
    out = {r.doc_id: r for r in lm.score(frame(spark, queries), trie).collect()}
    for i, q in enumerate(queries):
        n = len(split(q))
        assert out[i]["__n_words"] == n and out[i]["__text"] == "y"
        assert out[i]["__log_prob"] == pytest.approx(model.log_prob(q), abs=0.02 * n + 1e-9)  # 8 bits a probability
        assert (out[i]["__perplexity"] is None) == (n == 0)


def test_repeated_texts_are_told_apart(spark):
    """Documents that the corpus has twice are likelier than those it has once."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(80)) for _ in range(120)]
    docs = frame(spark, texts + texts[:40])
    out = {r.doc_id: r["__perplexity"] for r in lm.score(docs, lm.train(spark, docs)).collect()}
    once, twice = [out[i] for i in range(40, 120)], [out[i] for i in range(40)]
    assert np.mean([a < b for a in twice for b in once]) > 0.9


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 1), (1, 1), (5, 5), (1000, 100_000), (3000, 3100)):
        v = np.sort(rng.choice(universe, n, replace=False)).astype(np.uint64)
        ef = lm.EliasFano(lm.elias_fano(v, universe))
        assert (ef.access(np.arange(n)) == v).all()
        probe = np.arange(universe, dtype=np.uint64)
        want = np.full(universe, -1)
        want[v.astype(int)] = np.arange(n)
        assert (ef.find(probe) == want).all()
    same = lm.EliasFano(lm.elias_fano(np.array([0, 0, 3, 3, 3, 9], np.uint64), 10))
    assert same.access(np.arange(6)).tolist() == [0, 0, 3, 3, 3, 9]


def test_empty_corpus(spark):
    trie = lm.train(spark, frame(spark, []))
    rows = lm.score(frame(spark, ["ab", None]), trie).collect()
    assert rows[0]["__log_prob"] == 0 and rows[0]["__perplexity"] == 1 and rows[1]["__perplexity"] is None
    assert lm.score(frame(spark, []), lm.train(spark, frame(spark, TEXTS))).collect() == []


def test_only_the_trie_stays(spark, monkeypatch):
    """Counts are shuffled in packed pieces, merged by shard and gone when the trie is built; a shard with many pieces gives the same scores."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(60)) for _ in range(60)]
    docs = frame(spark, texts)
    monkeypatch.setattr(lm, "COUNTED", 200)
    trie = lm.train(spark, docs, 3000)
    assert {name.partition("-")[0].partition(".")[0] for name in os.listdir(os.path.dirname(trie.vocabulary))} == {"vocabulary", "1", "2", "3"}
    model = Brute(texts)
    for r in lm.score(docs, trie).collect():
        assert r["__log_prob"] == pytest.approx(model.log_prob(texts[r.doc_id]), abs=0.02 * 60)


def test_counts_of_contexts_beyond_32_bits():
    rng = np.random.default_rng(6)
    ctx, w = rng.integers(0, 5, 300).astype(np.uint64) << np.uint64(31), rng.integers(0, 9, 300).astype(np.uint64)
    want = sorted(Counter(zip(ctx.tolist(), w.tolist())).items())
    got = lm._unpack_counts(lm._pack_counts(*lm.counted(3, ctx, w)))
    assert [((a, b), c) for a, b, c in zip(*(x.tolist() for x in got))] == want
