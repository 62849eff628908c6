"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import U, Words, slices

MIN_WORDS = 10
SHORTEST = 5
SHARD_BYTES = 1 << 22
SLICE_BYTES = 16 << 20


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of tokens in order of their ranks, by prefix doubling; equal ones can't remain
    when the tokens end in one that occurs once."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    sa = np.argsort(tokens, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    t = tokens[sa]
    np.not_equal(t[1:], t[:-1], out=new[1:])
    begins = new  # first places of the groups, ever more of them
    group = np.flatnonzero(begins)
    rank = np.empty(n, np.int64)  # rank: first place of its group
    rank[sa] = np.repeat(group, np.diff(np.append(group, n)))
    step = 1
    while True:
        size = np.diff(np.append(group, n))
        many = size > 1
        if not many.any():
            return sa
        place = np.flatnonzero(np.repeat(many, size))  # only suffixes whose group isn't single are sorted again
        pos = sa[place]
        nxt = pos + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(rank[pos] * np.int64(n + 1) + second if n < 3_000_000_000 else second, kind="stable")
        pos, second = pos[by], second[by]
        sa[place] = pos
        head = rank[pos]
        fresh = np.empty(len(pos), bool)
        fresh[0] = True
        fresh[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        firsts = np.flatnonzero(fresh)
        rank[pos] = np.repeat(place[firsts], np.diff(np.append(firsts, len(pos))))
        begins[place[firsts]] = True
        group = np.flatnonzero(begins)
        step *= 2


class Tests:
    """The suffixes of the benchmark's items, as word hashes. need[i]: words that suffix i must match."""

    def __init__(self, ids: list, texts: list[str], min_words: int):
        w = Words.of(pa.array(texts, pa.large_string()))
        length = np.diff(w.first)
        self.need_of_item = np.minimum(length, min_words)
        self.ids, self.words = ids, w.hash
        self.item = w.text_of()
        self.end = w.first[1:][self.item]
        at = np.arange(len(self.words))
        ok = (length[self.item] >= SHORTEST) & (self.end - at >= self.need_of_item[self.item])
        self.at = at[ok]
        self.first = w.first


def _narrow(tokens: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """For each interval of sa, where in it the tokens at `depth` reach (or pass) `want`."""
    lo, hi, n = lo.copy(), hi.copy(), len(tokens)
    act = np.flatnonzero(lo < hi)
    while len(act):
        mid = (lo[act] + hi[act]) >> 1
        p = sa[mid] + depth
        inside = p < n
        got = tokens[np.minimum(p, n - 1)]
        less = ~inside | ((got <= want[act]) if right else (got < want[act]))
        lo[act] = np.where(less, mid + 1, lo[act])
        hi[act] = np.where(less, hi[act], mid)
        act = act[lo[act] < hi[act]]
    return lo


def search(tokens: np.ndarray, sa: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (training position, test position, words) of the matches that reach what their item needs."""
    at = tests.at
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    need = tests.need_of_item[tests.item[at]]
    pos, test = [], []
    depth = 0
    while len(at):
        want = tests.words[at + depth]
        left = _narrow(tokens, sa, lo, hi, depth, want, False)
        hi = _narrow(tokens, sa, left, hi, depth, want, True)
        lo, depth = left, depth + 1
        full = (lo < hi) & (need == depth)
        for k in np.flatnonzero(full):
            pos.append(sa[lo[k] : hi[k]])
            test.append(np.full(hi[k] - lo[k], at[k]))
        go = (lo < hi) & ~full
        at, lo, hi, need = at[go], lo[go], hi[go], need[go]
    if not pos:
        none = np.zeros(0, np.int64)
        return none, none, none
    p, q = np.concatenate(pos), np.concatenate(test)
    size = tests.need_of_item[tests.item[q]].astype(np.int64)
    act = np.arange(len(p))
    while len(act):
        i, j = p[act] + size[act], q[act] + size[act]
        go = (i < len(tokens)) & (j < tests.end[q[act]])
        go[go] = tokens[i[go]] == tests.words[j[go]]
        act = act[go]
        size[act] += 1
    return p, q, size


def _matcher(tests: Tests):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in slices(batch, most=SHARD_BYTES):
                w = Words.of(shard.column("text"))
                n = shard.num_rows
                count = np.diff(w.first)
                at = np.arange(len(w.hash)) + w.text_of()  # each text is closed by a token of its own
                tokens = np.empty(len(w.hash) + n, U)
                tokens[at] = w.hash
                tokens[w.first[1:] + np.arange(n)] = U(0xFFFFFFFF00000000) + np.arange(n, dtype=U)
                p, q, size = search(tokens, suffix_array(tokens), tests)
                if not len(p):
                    continue
                begin = w.first[:-1] + np.arange(n)
                doc = np.searchsorted(begin, p, "right") - 1
                item = tests.item[q]
                best = np.lexsort((p, q, -size, item, doc))
                best = best[np.append(True, (doc[best][1:] != doc[best][:-1]) | (item[best][1:] != item[best][:-1]))]
                doc, item = doc[best], item[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        shard.column("__row").take(pa.array(doc)),
                        pa.array([tests.ids[i] for i in item], pa.int64()),
                        pa.array(size[best].astype(np.int32)),
                        pa.array((p[best] - begin[doc]).astype(np.int32)),
                        pa.array((q[best] - tests.first[item]).astype(np.int32)),
                        pa.array(count[doc].astype(np.int32)),
                    ],
                    ["row", "item_id", "match_words", "doc_word", "item_word", "doc_words"],
                )

    return match


def _test_slices(benchmark: DataFrame, min_words: int) -> Iterator[Tests]:
    """The benchmark in slices of at most SLICE_BYTES of text, read one partition at a time."""
    ids, texts, size = [], [], 0
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= SLICE_BYTES:
            yield Tests(ids, texts, min_words)
            ids, texts, size = [], [], 0
    if ids:
        yield Tests(ids, texts, min_words)


SCHEMA = "item_id bigint, match_words int, doc_word int, item_word int, doc_words int"


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word, doc_words): for each affected document and each item that it has a passage of, their longest verbatim match.

    Words are compared without case and punctuation. A document is affected where it shares min_words consecutive
    words with an item, or all of an item of SHORTEST to min_words words; shorter items are left out.
    Ties: the first place in the item, then in the document; doc_word and item_word count
    from 0. A null doc_id is reported with a null; null texts have no words; repeated rows and rows of one doc_id are one
    document, as are items of one item_id; empty tables give an empty result. Both ids must be integers.

    Each task builds suffix arrays over shards of SHARD_BYTES of its texts and looks up all suffixes of the
    benchmark at once, narrowing their intervals word by word. Nothing is shuffled but the matches. The benchmark travels with the
    task in slices of SLICE_BYTES: a larger one costs another pass over the texts for each slice.
    """
    text = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("__row"), "text")
    out = None
    for tests in _test_slices(benchmark, min_words):
        part = text.mapInArrow(_matcher(tests), f"row bigint, {SCHEMA}")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], f"row bigint, {SCHEMA}")
    rank = F.struct((-F.col("match_words")).alias("m"), "item_word", "doc_word", "match_words", "doc_words")
    best = out.groupBy("row", "item_id").agg(F.min(rank).alias("b"))
    return best.select(F.col("row").alias("doc_id"), "item_id", "b.match_words", "b.doc_word", "b.item_word", "b.doc_words")


def _dropper(tests: Tests, columns: list[str]):
    find = _matcher(tests)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SHARD_BYTES):
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(part.schema.get_field_index("text"))], ["__row", "text"])
                bad = [r for found in find(iter([rows])) for r in found.column("row").to_pylist()]
                keep = np.ones(part.num_rows, bool)
                keep[bad] = False
                yield part.filter(pa.array(keep))

    return drop


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the affected rows (see contaminated), decided row by row within one narrow pass a slice."""
    for tests in _test_slices(benchmark, min_words):
        docs = docs.mapInArrow(_dropper(tests, docs.columns), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE text IS NOT NULL)),
b AS (
  SELECT item_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos, len(ws) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE text IS NOT NULL)),
dw AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY pos + 10 <= n),
bw AS (SELECT item_id, pos, string_agg(word, ' ') OVER o AS g FROM b WINDOW o AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY pos + 10 <= n),
m AS (SELECT dw.doc_id, bw.item_id, dw.pos AS dp, bw.pos AS bp, dw.n FROM dw JOIN bw USING (g)),
runs AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY dp) AS run FROM m),
long AS (SELECT doc_id, item_id, count(*) + 9 AS match_words, min(dp) AS dp, min(bp) AS bp, any_value(n) AS n FROM runs GROUP BY doc_id, item_id, dp - bp, run),
si AS (SELECT item_id, count(*) AS n, ' ' || string_agg(word, ' ' ORDER BY pos) || ' ' AS t FROM b WHERE n BETWEEN 5 AND 9 GROUP BY item_id),
sd AS (SELECT doc_id, count(*) AS n, ' ' || string_agg(word, ' ' ORDER BY pos) || ' ' AS t FROM w WHERE EXISTS (SELECT 1 FROM si) GROUP BY doc_id),
short AS (SELECT doc_id, item_id, si.n AS match_words, len(string_split(substr(sd.t, 1, strpos(sd.t, si.t)), ' ')) - 2 AS dp, 0 AS bp, sd.n AS n FROM sd JOIN si ON contains(sd.t, si.t)),
best AS (SELECT * FROM long UNION ALL SELECT * FROM short)
SELECT doc_id, item_id, CAST(match_words AS INTEGER) AS match_words, CAST(dp AS INTEGER) AS doc_word, CAST(bp AS INTEGER) AS item_word, CAST(n AS INTEGER) AS doc_words
FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY match_words DESC, bp, dp) = 1
"""
