"""Full-text and substring search: postings, BM25, snippets, keyset pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def build_search_index(docs: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, tf) and lengths (key, length) over all of the columns."""
    words = F.flatten(F.array(*[F.coalesce(tokens(c), F.array()) for c in columns]))
    t = docs.select(F.col(key).alias("key"), words.alias("w"))
    postings = t.select("key", F.explode("w").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    return postings, t.select("key", F.size("w").alias("length"))


def refresh_search_index(postings: DataFrame, lengths: DataFrame, changed: DataFrame, docs: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The index with the changed keys taken out and those of docs put in."""
    gone = changed.select(F.col(key).alias("key")).distinct()
    p, n = build_search_index(docs.join(changed.select(key).distinct(), key, "left_semi"), key, columns)
    return postings.join(gone, "key", "left_anti").unionByName(p), lengths.join(gone, "key", "left_anti").unionByName(n)


def copy_search_index(postings: DataFrame, snapshot_id: str) -> DataFrame:
    return postings.withColumn("snapshot_id", F.lit(snapshot_id))


def parse_query(query: str) -> tuple[list[str], list[str], list[str], bool]:
    """(terms, prefixes, excluded, any): words are all needed unless OR stands between them; word* is a prefix; NOT excludes."""
    must, prefix, out, any_, negate = [], [], [], False, False
    for w in re.findall(r"[\w*]+", query):
        if w == "OR":
            any_ = True
        elif w == "NOT":
            negate = True
        elif w != "AND":
            (out if negate else prefix if w.endswith("*") else must).append(w.rstrip("*").lower())
            negate = False
    return must, prefix, out, any_


def bm25(postings: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(key, rank) of the documents that match: minus the BM25 score, so less is better.

    The score is the sum over terms of idf tf (K1 + 1) / (tf + K1 (1 - B + B length / mean length)), with
    idf = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6). An empty query matches nothing.
    """
    must, prefix, out, any_ = parse_query(query)
    hit: Column = F.lit(None).cast("string")
    for t in must:
        hit = F.when(F.col("term") == t, t).otherwise(hit)
    for t in prefix:
        hit = F.when(hit.isNull() & F.col("term").startswith(t), t + "*").otherwise(hit)
    found = postings.withColumn("q", hit).filter("q IS NOT NULL").groupBy("key", "q").agg(F.sum("tf").alias("tf"))
    whole = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_len"))
    n = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len")))
    scored = found.join(F.broadcast(n), "q").join(lengths, "key").crossJoin(F.broadcast(whole)).groupBy("key").agg((-F.sum(part)).alias("rank"), F.count(F.lit(1)).alias("hits"))
    if not any_:
        scored = scored.filter(F.col("hits") == len(set(must)) + len(set(prefix)))
    if out:
        scored = scored.join(postings.filter(F.col("term").isin(out)).select("key").distinct(), "key", "left_anti")
    return scored.select("key", "rank")


def snippet(content: Column | str, terms: list[str], around: int = 5) -> Column:
    """Words about the first hit, the hits marked."""
    words = F.split(F.col(content) if isinstance(content, str) else content, r"\s+")
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", ""))
    first = F.array_min(F.array(*[F.when(F.array_position(low, t) > 0, F.array_position(low, t)) for t in terms], F.lit(None).cast("long")))
    part = F.slice(words, F.greatest(F.coalesce(first, F.lit(1)) - around, F.lit(1)).cast("int"), 2 * around + 1)
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")
    return F.array_join(F.transform(part, lambda w: F.when(plain(w).isin(terms), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def search_source(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best version of each path, by rank."""
    if not query.strip() or limit <= 0:
        return docs.select("path", F.lit(0.0).alias("rank")).limit(0)
    p, n = build_search_index(docs.filter("content IS NOT NULL"), "path", ["content"])
    best = bm25(p, n, query).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).filter("r = 1")
    return best.select(F.col("key").alias("path"), F.round("rank", 6).alias("rank")).orderBy("rank", "path").limit(limit)


def search_substring(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.filter(F.lower("fqn").contains(query.lower())).select("symbol_id", "fqn")


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """By terms over name, id and kind; where nothing matches and the query is one name, by substring."""
    chosen = symbols if kind is None else symbols.filter(F.col("kind") == kind)
    p, n = build_search_index(symbols.filter("fqn IS NOT NULL"), "symbol_id", ["fqn", "doc_comment_id", "kind"])
    hits = bm25(p, n, query).withColumnRenamed("key", "symbol_id").join(chosen.select("symbol_id", "fqn"), "symbol_id").select("symbol_id", "fqn", F.round("rank", 6).alias("rank"))
    if re.fullmatch(r"[A-Za-z0-9._]+", query) and ("." in query or hits.isEmpty()):
        hits = search_substring(chosen, query).withColumn("rank", F.lit(0.0))
    return hits.orderBy("rank", "symbol_id").limit(limit)


def keyset_page(ranked: DataFrame, order: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The rows after (order, key), limit + 1 of them: the last tells whether there are more."""
    rows = ranked if after is None else ranked.filter((F.col(order) > after[0]) | ((F.col(order) == after[0]) & (F.col(key) > after[1])))
    return rows.orderBy(order, key).limit(limit + 1)


def offset_page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order, and how many are left after them."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(rows.agg(F.greatest(F.count(F.lit(1)) - offset - limit, F.lit(0)).alias("remaining")))
