"""Line dedup, near dedup, decontamination, mixing, language ID and quality on small fixtures, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import decontam, langid, line_dedup, mixing, quality, simhash
from strataloom.llm._text import Words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, __id string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, "c", "x", None) for i, t, g, s in rows], SCHEMA)


def words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choices(alphabet, k=5)) for _ in range(n)]


# --- line dedup -------------------------------------------------------------------------------------------------


def brute_lines(rows):
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: r[0])
    seen, cut = {}, {}
    for i, t in docs:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen and seen[w] != (i, t, p):
                gone |= {p, p + 1, p + 2}
            seen.setdefault(w, (i, t, p))
        cut[i, t] = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
    return sorted(((i, cut.get((i, t), t)) for i, t in rows), key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [" ".join(words(rng, 3)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(100, None), (None, "a\nb\nc"), (None, "a\nb\nc"), (101, ""), (102, "\n\n\n\n"), (103, "one"), (5, rows[5][1]), (104, "a\nb\nc\na\nb\nc\na\nb\nc"), (105, "\n".join("z" for _ in range(5000)))]
    out = line_dedup.dedup_lines(spark, frame(spark, [(i, t, None, None) for i, t in rows]))
    assert out.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "__n_lines", "__n_removed"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(spark, frame(spark, [])).collect() == []


# --- near dedup -------------------------------------------------------------------------------------------------


def groups(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def meets(words, layout):
    """Brute force: for all pairs of signatures whether they are within DISTANCE and have a key in common."""
    bits = np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32)
    far = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    together = np.zeros(far.shape, bool)
    for key in simhash._values(words, simhash.sampled(*layout)):
        together |= key[:, None] == key[None, :]
    return far <= simhash.DISTANCE, together


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        rows.append((i, " ".join(words(rng, rng.randrange(40, 200))), None, "s"))
    for k in range(80):
        base = rng.randrange(150)
        w = rows[base][1].split()
        for _ in range(max(1, len(w) // rng.choice([12, 25, 50]))):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w), None, "s"))
    rows += [(2000, rows[3][1], None, None), (2001, rows[3][1].upper(), None, "s"), (3, rows[3][1], None, "s"), (2002, None, None, "s"), (2003, "", None, "s"), (2004, "...", None, "s"), (None, rows[3][1], None, "s"), (2005, "lone", None, "s"), (2006, "lone", None, "s"), (2007, rows[5][1], None, "s"), (2007, rows[6][1], None, "s"), (2008, "long " * 200_000, None, "s")]
    rows += [(3000 + k, rows[9][1], None, "s") for k in range(500)]
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in simhash.near_duplicates(spark, frame(spark, rows)).collect()}
    keep = sorted({(i, t) for i, t, *_ in rows if i is not None and t and t != "..."})
    sig, _ = simhash.signatures(Words.of(pa.array([t for _, t in keep])))
    sigs, of = np.unique(np.ascontiguousarray(sig).view(np.int64).reshape(len(keep), -1), axis=0, return_inverse=True)
    docs = {i: sorted({int(of.ravel()[k]) for k, (j, _) in enumerate(keep) if j == i}) for i, _ in keep}
    holders = [sorted(i for i in docs if s in docs[i]) for s in range(len(sigs))]
    close, together = meets(sigs, simhash.layout(len(sigs)))
    linked = close & together & ~np.eye(len(sigs), dtype=bool)
    pairs = [(holders[a][0], holders[b][0]) for a, b in np.argwhere(linked)] + [(h[0], i) for h in holders for i in h[1:]]
    root = groups(pairs)
    want = {i: (root.get(i, i), sum(len(holders[s]) - 1 for s in docs.get(i, [])), int(sum(linked[s].sum() for s in docs.get(i, [])))) for i, *_ in rows if i is not None}
    assert got == want
    assert (close & together).sum() >= 0.95 * close.sum() and linked.sum() > 50
    assert got[2001][0] == got[3][0] and got[2006] == (2005, 1, 0) and got[2003] == (2003, 0, 0)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark, frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted((i for i, *_ in rows if i is None or want[i][0] == i), key=str)
    monkeypatch.setattr(simhash, "SPLIT", 1)  # every bucket of several rows is cut into chunks
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in simhash.near_duplicates(spark, frame(spark, rows)).collect()} == want
    assert simhash.near_duplicates(spark, frame(spark, [])).collect() == []


def near_pairs(rng, n, order):
    """Signatures that agree on the coordinates of a table, 2k and 2k + 1 at a distance of 30 to 48."""
    sig = rng.integers(0, 2, (2 * n, simhash.BITS)).astype(np.uint8)
    sig[:, order] = 1
    free = np.setdiff1d(np.arange(simhash.BITS), order)
    for k in range(n):
        sig[2 * k + 1] = sig[2 * k]
        sig[2 * k + 1, rng.choice(free, 30 + k % 19, replace=False)] ^= 1
    return np.packbits(sig, axis=1).view(np.int64)


@pytest.mark.parametrize("chunks", [1, 5])
def test_large_buckets_lose_no_pair(chunks):
    n = 300
    orders = simhash.sampled(*simhash.layout(2 * n))
    sig = near_pairs(np.random.default_rng(6), n, orders[0])
    key = int(next(simhash._values(sig[:1], orders))[0])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), *[pa.array(sig[:, k]) for k in range(4)]], ["id", *simhash.WORDS])
    t = pa.Table.from_batches(list(simhash._keys(orders, {key: chunks} if chunks > 1 else {})([batch])))
    t = t.filter(pa.array(t["key"].to_numpy() == key)).sort_by([("key", "ascending"), ("part", "ascending")])
    out = pa.Table.from_batches(list(simhash._linker(orders)(iter(t.to_batches(max_chunksize=100)))))
    found = set(zip(out["a"].to_pylist(), out["b"].to_pylist(), out["links"].to_pylist()))
    assert found >= {(2 * k + 1, 2 * k, 0) for k in range(n)} and found >= {(i, i, 1) for i in range(2 * n)}


def test_recall_holds_at_every_size():
    p = 1 - simhash.DISTANCE / simhash.BITS
    for n in (0, 1, 10**5, 10**7, 10**9, 10**11):
        bits, tables = simhash.layout(n)
        assert 1 - (1 - p**bits) ** tables >= simhash.RECALL and n / 2**bits <= simhash.BUCKET
    rng = np.random.default_rng(8)
    for size in (1 << 20, 1 << 26):
        orders = simhash.sampled(*simhash.layout(size))
        pairs = np.packbits(rng.integers(0, 2, (2000, simhash.BITS)).astype(np.uint8), axis=1)
        flips = np.zeros((2000, simhash.BITS), np.uint8)
        for row in flips:
            row[rng.choice(simhash.BITS, simhash.DISTANCE, replace=False)] = 1
        other = pairs ^ np.packbits(flips, axis=1)
        met = np.zeros(2000, bool)
        for a, b in zip(simhash._values(pairs.view(np.int64), orders), simhash._values(other.view(np.int64), orders)):
            met |= a == b
        assert met.mean() >= simhash.RECALL - 0.03


# --- decontamination --------------------------------------------------------------------------------------------


def brute_match(doc, items, least=decontam.MIN_WORDS):
    """For each item its longest match with the document."""
    d, best = [w.lower() for w in doc.replace(".", " ").replace(",", " ").split()], {}
    for item, text in items:
        t = [w.lower() for w in text.replace(".", " ").split()]
        need = min(least, len(t))
        if len(t) < decontam.SHORTEST:
            continue
        for j in range(len(t)):
            for i in range(len(d)):
                n = 0
                while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n]:
                    n += 1
                if n >= need and (item not in best or (-n, j, i) < best[item]):
                    best[item] = (-n, j, i)
    return {item: (-n, i, j) for item, (n, j, i) in best.items()}


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.choice([4, 7, 12, 25])))) for k in range(12)] + [(50, None), (None, "a b c d e f g"), (3, "again " * 12), (51, "")]
    docs = []
    for i in range(50):
        w = words(rng, rng.randrange(5, 60))
        if rng.random() < 0.5:
            t = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(t))
            w[3:3] = [x.upper() + "," for x in t[a : a + rng.randrange(3, 25)]]
            if rng.random() < 0.5:
                w += " ".join(x for _, x in rng.sample(items[:12], 2)).split() + w[:3]
        docs.append((i, " ".join(w), None, None))
    docs += [(100, None, None, None), (101, "", None, None), (None, items[2][1], None, None), (7, docs[7][1], None, None), (102, "pad " * 50_000 + items[3][1], None, None)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, __row string")
    known = [(i, t) for i, t in items if i is not None and t]
    got = {}
    for r in decontam.contaminated(spark, frame(spark, docs), bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.match_words, r.doc_word, r.item_word
    want = {i: m for i, t, *_ in docs if t and i != 102 and (m := brute_match(t, known))}
    assert {k: v for k, v in got.items() if k != 102} == want and len(want) > 5 and any(len(m) > 1 for m in want.values())
    assert (102 in got) == (len(items[3][1].split()) >= decontam.SHORTEST)
    left = decontam.decontaminate(spark, frame(spark, docs), bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, *_ in docs if i not in got), key=str)
    assert left.columns == frame(spark, docs).columns
    assert decontam.contaminated(spark, frame(spark, docs), bench.limit(0)).collect() == []
    assert decontam.contaminated(spark, frame(spark, []), bench).collect() == []


# --- mixing -----------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(words(rng, rng.randrange(1, 30))), None, rng.choice(["a", "b", "c", None])) for i in range(300)]
    docs += [(300, None, None, "a"), (301, "", None, "empty"), (None, "x y", None, "b"), (5, docs[5][1], None, docs[5][3])]
    for targets in (None, {"a": 3.0, "b": 1.0}):
        tokens = {}
        for _, t, _, s in docs:
            tokens[s] = tokens.get(s, 0) + len((t or "").split())
        weight = {s: (n**0.7 if targets is None else targets.get(s, 0.0)) if n else 0.0 for s, n in tokens.items()}
        rate = {s: round(weight[s] / sum(weight.values()) * sum(tokens.values()) / n, 9) if n else 1.0 for s, n in tokens.items()}
        want = []
        for i, _, _, s in docs:
            u = int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
            n = int(rate[s]) + (u < rate[s] - int(rate[s]))
            want += [(i, s, k) for k in range(1, n + 1)]
        out = mixing.mix_sources(spark, frame(spark, docs), targets)
        assert sorted(((r.doc_id, r.source, r["copy"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert mixing.mix_sources(spark, frame(spark, [])).collect() == []


# --- language ID ------------------------------------------------------------------------------------------------

SOUNDS = {"en": "th er an re he in on".split(), "de": "sch ung ein ch ge ü ß".split(), "fr": "eau è que oi ment é ç".split(), "es": "ción ñ ado rr ll os ó".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(6)
    docs = [(i, speak(rng, g, rng.randrange(5, 40)), g, "s") for i, g in enumerate(rng.choices(list(SOUNDS), k=240))]
    model = langid.train(spark, frame(spark, docs), sample=40)
    truth = {1000 + i: g for i, g in enumerate(rng.choices(list(SOUNDS), k=200))}
    held = [(i, speak(rng, g, rng.randrange(5, 40)), None, "s") for i, g in truth.items()]
    odd = [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "12 34 %% 5", "en", "s"), (2003, "это другой язык совсем", "en", "s"), (2004, "中文文本测试内容", None, "s"), (None, held[0][1], None, "s"), (1000, held[0][1], None, "s"), (2005, speak(rng, "de", 300_000), "en", "s")]
    out = langid.identify(spark, frame(spark, held + odd), model)
    rows = [r for r in out.collect()]
    by = {r.doc_id: r for r in rows}
    assert np.mean([by[i]["__language"] == g for i, g in truth.items()]) >= 0.95
    assert np.mean([by[i]["__accepted"] for i in truth]) >= 0.99
    for i in (2000, 2001, 2002):
        assert not by[i]["__accepted"] and by[i]["__language"] is None
    assert not by[2003]["__accepted"] and not by[2004]["__accepted"]
    assert by[2005]["__language"] == "de" and by[2005]["__family"] == "germanic"
    assert len(rows) == len(held + odd) and "copy" in out.columns
    none = langid.identify(spark, frame(spark, [(1, "text", None, "s")]))
    assert [r["__accepted"] for r in none.collect()] == [False]
    assert langid.identify(spark, frame(spark, []), model).collect() == []


def later(spark, n, first):
    """Which of the ids from 0 to n - 1 aren't among the `first` ones by hash."""
    order = sorted((r.h, r.id) for r in spark.range(n).selectExpr("id", "xxhash64(id) h").collect())
    return {i for _, i in order[first:]}


@pytest.mark.parametrize("sample", [20, 1000])
def test_language_learns_from_all_rows(spark, sample):
    """A dialect that only documents beyond the first ones by hash speak is known too, in one block or in many."""
    rng = random.Random(12)
    dialect = "xw zk qv jx wq".split()
    late = later(spark, 120, 20)
    docs = [(i, " ".join("".join(rng.choices(dialect, k=3)) for _ in range(20)) if i in late else speak(rng, "de", 20), "de", "s") for i in range(120)]
    docs += [(1000 + i, speak(rng, g, 20), g, "s") for i, g in enumerate(["en", "fr", "es"] * 40)]
    model = langid.train(spark, frame(spark, docs), sample=sample)
    held = [(k, " ".join("".join(rng.choices(dialect, k=3)) for _ in range(20)), None, "s") for k in range(40)]
    held += [(100 + k, speak(rng, g, 20), g, "s") for k, g in enumerate(["en", "fr", "es"] * 20)]
    by = {r.doc_id: r for r in langid.identify(spark, frame(spark, held), model).collect()}
    assert all(by[k]["__language"] == "de" and by[k]["__accepted"] for k in range(40))
    assert np.mean([by[i]["__language"] == g and by[i]["__accepted"] for i, _, g, _ in held[40:]]) >= 0.95


def test_exact_quantile(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 3000):
        v = np.round(rng.random(n) * 1.5, 3)
        got = langid.quantile(spark.createDataFrame([(float(x),) for x in v], "v double"), 0.01)
        assert got == pytest.approx(float(np.quantile(v, 0.01)), abs=1e-12)
    assert langid.quantile(spark.createDataFrame([], "v double"), 0.01) is None


def test_packed_vectors():
    x, _ = langid.features(pa.array(["some words of a text", "a", "Zoë " * 3000]))
    for v in x:
        assert (langid._unpacked(langid._packed(v)) == v.astype(np.float16).astype(np.float32)).all()


def test_packed_vectors_are_small():
    """Few different values, as of a text's counts, take less than a byte for each place that isn't 0, besides the bits; many are kept too."""
    rng = np.random.default_rng(7)
    x = np.zeros(langid.DIMENSIONS, np.float32)
    x[rng.permutation(langid.DIMENSIONS)[:2000]] = np.sqrt(rng.geometric(0.4, 2000)) / 70
    assert len(langid._packed(x)) < langid.DIMENSIONS // 8 + 1000
    for n in (0, 255, 256, 257, 4000):
        many = np.zeros(langid.DIMENSIONS, np.float32)
        many[:n] = np.linspace(0.001, 1, n)
        for v in (x, many):
            assert (langid._unpacked(langid._packed(v)) == v.astype(np.float16).astype(np.float32)).all()


# --- quality ----------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(7)

    def make(i, bad, toxic):
        w = words(rng, rng.randrange(30, 80))
        if toxic:
            w[5] = rng.choice(["awful", "nasty"])
        return (i, " ".join((x + "%%%" if bad else x) for x in w), None, "s")

    kinds = [(rng.random() < 0.3, rng.random() < 0.3) for _ in range(400)]
    docs = [make(i, *k) for i, k in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(not b), int(t)) for i, (b, t) in enumerate(kinds[:250])] + [(3, None, 1), (None, 1, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(spark, frame(spark, docs), labels)
    odd = [(1000, None, None, None), (1001, "", None, None), (1002, "!!!", None, None), (None, docs[0][1], None, None), (0, docs[0][1], None, None), (1003, "word " * 300_000, None, None)]
    out = quality.classify(frame(spark, docs + odd), model).collect()
    by = {r.doc_id: r for r in out}
    held = range(250, 400)
    assert np.mean([(by[i]["__quality"] >= 0.5) == (not kinds[i][0]) for i in held]) >= 0.95
    assert np.mean([(by[i]["__toxic"] >= 0.5) == kinds[i][1] for i in held]) >= 0.95
    assert all(by[i]["__quality"] is None and not by[i]["__keep"] for i in (1000, 1001, 1002))
    assert len(out) == len(docs + odd)
    empty = quality.train(spark, frame(spark, docs), labels.limit(0))
    assert [r["__keep"] for r in quality.classify(frame(spark, docs[:1]), empty).collect()] == [False]
    assert quality.classify(frame(spark, []), model).collect() == []


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only an interaction can tell
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and np.mean((m.probability(x) >= 0.5) == y) > 0.95
    one = np.full(len(x), m.bias)
    for r in range(len(x)):
        one[r] += sum(t[np.searchsorted(m.edges[k], x[r, k], "right")] for k, t in enumerate(m.tables))
        one[r] += sum(t[np.searchsorted(m.coarse[i], x[r, i], "right"), np.searchsorted(m.coarse[j], x[r, j], "right")] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert one == pytest.approx(m.odds(x))
