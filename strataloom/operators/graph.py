"""Operators on typed edge lists (src, dst, kind, provenance, doc, line, cross_generated, type_args).

All are plans of joins and aggregations; the loops over depth build one plan, or write a round to the
shared folder where the number of rounds isn't fixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.project import PROVENANCE
from ..sources.shared import bucketed, materialise

KEY = ["src", "dst", "kind"]
#: A frontier of so many nodes is sent to all tasks; so many rounds read the edges as they are; so many keys make a filter.
FEW, ROUNDS, MANY = 100_000, 4, 1000


def provenance_rank(c: str | Column = "provenance") -> Column:
    """-1 for unknown ones to 6 for what the compiler proved."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.lit(-1)
    for i, p in enumerate(PROVENANCE):
        out = F.when(col == p, i - 1).otherwise(out)
    return out


def edge_dedup(raw: DataFrame, dealt: tuple[str, ...] = ("src",)) -> DataFrame:
    """One edge for each (src, dst, kind): that of the highest provenance, ties by document, line and flag; type arguments of all are united.

    Rows are shuffled once, as they are, and sorted by key: hardly a key repeats, so merging before the shuffle holds and spills all rows of a task and saves none.
    They are dealt by src (what starts at one symbol is bounded by its source text, what ends there isn't), which later joins and groups by src use; KEY instead serves full joins by key.
    """
    best = Window.partitionBy(*KEY).orderBy("__rank", "doc", "line", "cross_generated", "provenance")
    every = F.collect_set("type_arg").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = raw.repartition(*dealt).withColumn("__rank", (-provenance_rank()).cast("byte"))
    one = rows.withColumns({"__n": F.row_number().over(best), "__args": F.array_join(F.array_sort(every), ",")}).filter("__n = 1")
    return one.select(*KEY, "provenance", "doc", "line", "cross_generated", F.when(F.col("__args") != "", F.col("__args")).alias("type_args"))


def links(edges: DataFrame) -> DataFrame:
    """The distinct (src, dst, kind), dealt by src like the edges of edge_dedup, without their evidence."""
    rows = edges.select(*KEY).repartition("src")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy("kind"))).filter("__n = 1").select(*KEY)


def by_kind(edges: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    return edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))


def touching(edges: DataFrame, symbol: str | None = None) -> DataFrame:
    return edges if symbol is None else edges.filter((F.col("src") == symbol) | (F.col("dst") == symbol))


def among(edges: DataFrame, end: str, keys: DataFrame) -> DataFrame:
    """Edges whose end (src or dst) is one of the keys (one column). Up to MANY keys become a filter, which is applied where the edges are read, before they are
    deduplicated and shuffled; more a semi-join. The keys are read twice, so they had better be written, or few."""
    name = keys.columns[0]
    some = [r[0] for r in keys.filter(F.col(name).isNotNull()).limit(MANY + 1).collect()]
    return edges.filter(F.col(end).isin(some)) if len(some) <= MANY else edges.join(keys.select(F.col(name).alias("__key")), F.col(end) == F.col("__key"), "left_semi")


def neighbors_out(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.filter(F.col("src") == symbol)


def neighbors_in(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.filter(F.col("dst") == symbol)


def trace_impact(edges: DataFrame, seeds: list[str], downstream: bool = True, kinds: Iterable[str] | None = None, max_depth: int = 3, raw: bool = False) -> DataFrame:
    """(seed, chain, steps, truncated, first_kind, first_node, first_provenance): the maximal simple paths from each seed.

    A path of max_depth steps is reported as truncated without a look at what follows. Shorter ones are reported
    where no edge of the kinds leads to a node that isn't on the path. A seed without such edges has no path; loops
    are not followed; parallel edges of different kinds make different paths.

    Each step keeps of the edges those that start at the frontier, by a semi-join (a small frontier is broadcast by its known size), and
    only then, where they are raw, deduplicates them: the frontier's end is part of the key. It writes the new frontier to the shared folder. Paths that
    ended are set aside, so nothing is evaluated twice.
    """
    here, there = ("src", "dst") if downstream else ("dst", "src")
    step = by_kind(edges, kinds)
    columns = ["seed", "cur", "visited", "chain", "steps", "first_kind", "first_node", "first_provenance"]
    none = F.lit(None).cast("string")
    front = edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string").select("seed", F.col("seed").alias("cur"), F.array("seed").alias("visited"), F.lit("").alias("chain"), F.lit(0).alias("steps"), none.alias("first_kind"), none.alias("first_node"), none.alias("first_provenance"))
    done = []
    for depth in range(max_depth):
        at = front.select(F.col("cur").alias("at")).distinct()
        near = step.join(at, F.col(here) == F.col("at"), "left_semi")
        near = (edge_dedup(near) if raw else near).select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("kind").alias("k"), F.col("provenance").alias("pv"))
        j = front.join(near, (F.col("cur") == F.col("at")) & ~F.array_contains("visited", F.col("next")), "left")
        go = F.col("next").isNotNull()
        first = {c: F.when(go, F.col(x)) if depth == 0 else F.col(c) for c, x in (("first_kind", "k"), ("first_node", "next"), ("first_provenance", "pv"))}
        p = materialise(j.select(
            "seed", F.coalesce("next", "cur").alias("cur"), F.when(go, F.array_append("visited", F.col("next"))).otherwise(F.col("visited")).alias("visited"),
            F.when(go, F.concat("chain", F.lit(">"), "k", F.lit(":"), "next")).otherwise(F.col("chain")).alias("chain"),
            F.when(go, F.col("steps") + 1).otherwise(F.col("steps")).alias("steps"), *[v.alias(c) for c, v in first.items()], go.alias("go")))
        done.append(p.filter("NOT go AND steps > 0").select(*columns, F.lit(False).alias("truncated")))
        front = p.filter("go").select(*columns)
        if front.isEmpty():
            break
    done.append(front.filter("steps > 0").select(*columns, F.lit(True).alias("truncated")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("seed", "chain", "steps", "truncated", "first_kind", "first_node", "first_provenance")


def impact_groups(paths: DataFrame) -> DataFrame:
    """Paths by their first step: how many, the longest, and the first step's provenance."""
    return paths.groupBy("seed", "first_node", "first_kind").agg(F.count(F.lit(1)).alias("paths"), F.max("steps").alias("max_steps"), F.min("first_provenance").alias("provenance"))


def path_order(paths: DataFrame) -> DataFrame:
    """Rank of each path: by its first step, its length, its chain."""
    key = [F.col("first_node"), F.col("first_kind"), F.lpad(F.col("steps").cast("string"), 4, "0"), F.col("chain")]
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*key)))


def reachable(edges: DataFrame, seeds: DataFrame, downstream: bool = True, max_depth: int | None = None) -> DataFrame:
    """(node, depth) for each node within max_depth steps of any seed (column node), the seeds at depth 0.

    A breadth-first search by rounds: each joins its frontier with the edges and drops what is known. The rounds are written to
    the shared folder; it ends with an empty frontier. While the frontier has at most FEW nodes the edges are filtered by it where they are read. Once it has more,
    or after ROUNDS, their ends are stored in buckets of the node they are left from, so that later rounds shuffle what they find and never the edges again.
    """
    here, there = ("src", "dst") if downstream else ("dst", "src")
    step = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).filter("node <> next")
    known = front = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth, stored = 0, None
    try:
        while max_depth is None or depth < max_depth:
            depth += 1
            few = front.count() <= FEW
            if stored is None and (depth > ROUNDS or not few):
                step = bucketed(step, "node", stored := f"step_{uuid.uuid4().hex}")
            at = front.select("node")
            near = among(step, "node", F.broadcast(at) if few else at.hint("shuffle_hash")).select(F.col("next").alias("node"))
            front = materialise(near.distinct().join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
            if front.isEmpty():
                break
            known = known.unionByName(front)
    finally:
        if stored:
            edges.sparkSession.sql(f"DROP TABLE IF EXISTS {stored}")
    return known


def with_declared_members(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, member): each symbol with itself and, for a type, what it declares."""
    own = symbols.select("symbol_id", F.col("symbol_id").alias("member"))
    declared = edges.filter("kind = 'Declares'").select(F.col("src").alias("symbol_id"), F.col("dst").alias("member")).filter("symbol_id LIKE 'T:%'")
    return own.union(declared.join(symbols.select("symbol_id"), "symbol_id", "left_semi"))


def is_assignable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): the reflexive closure over Implements and Inherits, from each node.

    The hierarchy is shallow, so the closure doubles its reach each round and takes the logarithm of its height in rounds.
    """
    up = by_kind(edges, ["Implements", "Inherits"]).select("src", "dst").distinct()
    all_ = materialise(up)
    while True:
        longer = all_.alias("a").join(all_.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new = materialise(all_.union(longer).distinct())
        if new.count() == all_.count():
            break
        all_ = new
    return all_.union(nodes.select(F.col("symbol_id").alias("src"), F.col("symbol_id").alias("dst"))).distinct()


def receiver_compatible(closure: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, ok) for rows (id, type, alternatives array<array<string>>): whether type is assignable to all types of one alternative."""
    known = closure.groupBy(F.col("src").alias("type")).agg(F.collect_set("dst").alias("bases"))
    ok = F.exists("alternatives", lambda alt: F.forall(alt, lambda t: F.array_contains("bases", t)))
    return wanted.join(known, "type", "left").select("id", F.coalesce(ok, F.lit(False)).alias("ok"))


def split_orphans(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among nodes (symbol_id), and the others with `dropped`: compiler_synthesized, external or other."""
    known = lambda end, flag: nodes.select(F.col("symbol_id").alias(end)).distinct().withColumn(flag, F.lit(True))
    e = edges.join(known("src", "ns"), "src", "left").withColumn("ns", F.col("ns").isNotNull()).join(known("dst", "nd"), "dst", "left").withColumn("nd", F.col("nd").isNotNull())
    missing = F.when(~F.col("ns"), F.col("src")).otherwise(F.col("dst"))
    why = F.when(missing.contains("<") | missing.contains("$"), "compiler_synthesized").when(F.substring_index(missing, "|", -1).isin("inv", "geo"), "external").otherwise("other")
    return e.filter("ns AND nd").select(*edges.columns), e.filter("NOT (ns AND nd)").select(*edges.columns, why.alias("dropped"))


def orphan_summary(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("dropped").agg(F.count(F.lit(1)).alias("edges"))


def project_closure(references: DataFrame, changed: DataFrame) -> DataFrame:
    """Projects that reference a changed one, directly or not, and these themselves. references: (project, referenced)."""
    edges = references.select(F.col("project").alias("src"), F.col("referenced").alias("dst"))
    return reachable(edges, changed.select(F.col("project").alias("node")), downstream=False).select(F.col("node").alias("project"))


def reverse_doc_closure(edges: DataFrame, declared: DataFrame, changed: DataFrame, ratio: float = 0.6) -> tuple[DataFrame, bool]:
    """Documents whose edges lead to a symbol that an affected document declares, from the changed ones on; whether it was given up.

    declared: (symbol_id, path); changed: (path). Where more than `ratio` of all documents are affected the closure is
    given up and the caller widens the scope.
    """
    reads = edges.filter("doc IS NOT NULL").select("doc", F.col("dst").alias("symbol_id")).distinct().join(declared, "symbol_id").select(F.col("doc").alias("src"), F.col("path").alias("dst"))
    total = declared.select("path").distinct().count()
    step = materialise(reads.filter("src <> dst").distinct())
    known = materialise(changed.select(F.col("path").alias("node")).distinct())
    front = known
    while True:
        new = step.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(known, "node", "left_anti")
        front = materialise(new)
        if front.isEmpty():
            return known.select(F.col("node").alias("path")), False
        known = materialise(known.union(front))
        if known.count() > ratio * total:
            return known.select(F.col("node").alias("path")), True


def expand_partial_parts(declared: DataFrame, seed: DataFrame) -> DataFrame:
    """(path): all documents that declare a part of a type that a seed document (path) declares. declared: (symbol_id, path)."""
    types = declared.join(seed.select("path").distinct(), "path", "left_semi").select("symbol_id").distinct()
    return declared.join(types, "symbol_id", "left_semi").select("path").distinct()
