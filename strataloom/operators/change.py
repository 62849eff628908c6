"""Diffs of snapshots, what-ifs, audits, freshness and the upkeep of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .graph import KEY, among, by_kind, edge_dedup, reachable

ALIVE = ["Calls", "References", "Overrides", "Implements", "Registers"]


# --- diffs ------------------------------------------------------------------------------------------------------


def diff_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol_id, change): added, removed or common."""
    j = a.select("symbol_id", F.lit(1).alias("x")).join(b.select("symbol_id", F.lit(1).alias("y")), "symbol_id", "full")
    return j.select("symbol_id", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("common").alias("change"))


def simple_name(fqn: str) -> Column:
    return F.substring_index(fqn, ".", -1)


def diff_rename_move(a: DataFrame, b: DataFrame) -> DataFrame:
    """For ids of both whose name differs: renamed where the last part does, moved where the rest does, a row for each."""
    j = a.select("symbol_id", F.col("fqn").alias("old")).join(b.select("symbol_id", F.col("fqn").alias("new")), "symbol_id").filter("old <> new")
    box = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, ".", -1)))
    kinds = F.array_compact(F.array(F.when(simple_name("old") != simple_name("new"), F.lit("renamed")), F.when(box(F.col("old")) != box(F.col("new")), F.lit("moved"))))
    return j.select("symbol_id", "old", "new", F.explode(kinds).alias("change"))


def diff_metadata(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(symbol_id, key, old, new) for each metadata column that differs where both have it."""
    rows = lambda df: df.select("symbol_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])).alias("m")).select("symbol_id", "m.key", "m.v")
    j = rows(a).withColumnRenamed("v", "old").join(rows(b).withColumnRenamed("v", "new"), ["symbol_id", "key"])
    return j.filter("old IS NOT NULL AND new IS NOT NULL AND old <> new")


def diff_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (symbol_id, signature, body): body_only_changed, signature_changed, or comparison_unavailable where a side lacks its text."""
    j = a.select("symbol_id", F.col("signature").alias("s1"), F.col("body").alias("b1")).join(b.select("symbol_id", F.col("signature").alias("s2"), F.col("body").alias("b2")), "symbol_id")
    lost = F.col("b1").isNull() != F.col("b2").isNull()
    change = F.when(lost | F.col("s1").isNull() | F.col("s2").isNull(), "comparison_unavailable").when((F.col("s1") == F.col("s2")) & (F.col("b1") != F.col("b2")), "body_only_changed").when(F.col("s1") != F.col("s2"), "signature_changed")
    return j.select("symbol_id", change.alias("change")).filter("change IS NOT NULL")


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, kind, change): added, removed, evidence_changed, location_changed; an edge can have both of the latter."""
    cols = ["provenance", "doc", "line", "cross_generated", "type_args"]
    x = a.select(*KEY, F.struct(*cols).alias("x"))
    y = b.select(*KEY, F.struct(*cols).alias("y"))
    j = x.join(y, KEY, "full")
    differ = lambda names: ~F.struct(*[F.col(f"x.{n}") for n in names]).eqNullSafe(F.struct(*[F.col(f"y.{n}") for n in names]))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    changes = F.array_compact(F.array(F.when(F.col("x").isNull(), F.lit("added")), F.when(F.col("y").isNull(), F.lit("removed")), F.when(both & differ(["provenance", "cross_generated", "type_args"]), F.lit("evidence_changed")), F.when(both & differ(["doc", "line"]), F.lit("location_changed"))))
    return j.select(*KEY, F.explode(changes).alias("change"))


def match_transitions(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old, new, transition): removed and added symbols of one kind, assembly and fingerprint, where exactly one of each has them.

    rows: (symbol_id, kind, assembly, fqn, fingerprint).
    """
    key = ["kind", "assembly", "fingerprint"]
    one = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("symbol_id", "fqn")).alias("s")).filter("n = 1").drop("n")
    j = one(removed).withColumnRenamed("s", "o").join(one(added).withColumnRenamed("s", "w"), key)
    box = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, ".", -1)))
    name, move = simple_name("o.fqn") != simple_name("w.fqn"), box(F.col("o.fqn")) != box(F.col("w.fqn"))
    return j.select(F.col("o.symbol_id").alias("old"), F.col("w.symbol_id").alias("new"), F.when(name & move, "rename_and_move").when(name, "rename").when(move, "move").otherwise("same").alias("transition"))


def diff_scoped(diff: DataFrame, changed: DataFrame) -> DataFrame:
    """Edge changes with a changed symbol (symbol_id) at either end. The diff is made once, both ends are looked up in one go."""
    c = lambda end: changed.select(F.col("symbol_id").alias(end)).distinct().withColumn(f"__{end}", F.lit(True))
    return diff.join(c("src"), "src", "left").join(c("dst"), "dst", "left").filter("__src OR __dst").select(*diff.columns)


# --- what-ifs ---------------------------------------------------------------------------------------------------


def _members(edges: DataFrame, symbol: str, any_symbol: bool) -> DataFrame:
    own = edges.sparkSession.range(1).select(F.lit(symbol).alias("m"))
    if not any_symbol and not symbol.startswith("T:"):
        return own
    return materialise(own.union(edges.filter((F.col("kind") == "Declares") & (F.col("src") == symbol)).select("dst")).distinct())


def simulate_rename(edges: DataFrame, symbol: str) -> DataFrame:
    """(affected, kind, doc, line): who names the symbol or a member of it; and what it overrides."""
    m = _members(edges, symbol, True)
    into = among(by_kind(edges, ALIVE), "dst", m).select(F.col("src").alias("affected"), "kind", "doc", "line").distinct()
    return into.unionByName(edges.filter((F.col("kind") == "Overrides") & (F.col("src") == symbol)).select(F.col("dst").alias("affected"), "kind", "doc", "line"))


def simulate_move(edges: DataFrame, symbol: str) -> DataFrame:
    """The same without what it overrides, with members for types only."""
    m = _members(edges, symbol, False)
    return among(by_kind(edges, ALIVE), "dst", m).select(F.col("src").alias("affected"), "kind", "doc", "line").distinct()


def simulate_remove(edges: DataFrame, symbol: str, max_depth: int = 10) -> DataFrame:
    """(affected, depth): all that reaches the symbol or a member within max_depth steps, and at depth 0 what it registers, is tested by or implements.

    The reach is a set, so no paths are enumerated.
    """
    m = _members(edges, symbol, False)
    up = reachable(edges, m.select(F.col("m").alias("node")), downstream=False, max_depth=max_depth).filter("depth > 0")
    out = by_kind(edges, ["Registers", "TestedBy", "Implements"]).filter(F.col("src") == symbol).select(F.col("dst").alias("node"), F.lit(0).alias("depth"))
    every = up.unionByName(out).join(m, F.col("node") == F.col("m"), "left_anti")
    return every.groupBy(F.col("node").alias("affected")).agg(F.min("depth").alias("depth"))


# --- audits -----------------------------------------------------------------------------------------------------


def audit_dead(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols without an edge of the kinds of ALIVE into them or, for types, into what they declare."""
    used = by_kind(edges, ALIVE).select(F.col("dst").alias("symbol_id")).distinct()
    by_member = edges.filter("kind = 'Declares' AND src LIKE 'T:%'").join(used.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select(F.col("src").alias("symbol_id"))
    return symbols.select("symbol_id").join(used.union(by_member), "symbol_id", "left_anti")


def audit_untested(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Public and internal symbols that no test covers and that no covered type declares."""
    tested = edges.filter("kind = 'TestedBy'").select(F.col("src").alias("symbol_id")).distinct()
    inside = edges.filter("kind = 'Declares'").join(tested.withColumnRenamed("symbol_id", "src"), "src", "left_semi").select(F.col("dst").alias("symbol_id"))
    return symbols.filter(F.col("accessibility").isin("Public", "Internal")).select("symbol_id").join(tested.union(inside), "symbol_id", "left_anti")


def audit_unregistered(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each Implements edge whose type isn't registered; interfaces and abstract types are left out."""
    concrete = symbols.filter("type_kind = 'Class' AND NOT is_abstract").select(F.col("symbol_id").alias("src"))
    registered = edges.filter("kind = 'Registers'").select(F.col("dst").alias("src")).distinct()
    return edges.filter("kind = 'Implements'").join(concrete, "src", "left_semi").join(registered, "src", "left_anti").select("src", "dst")


def audit_fan_out(edges: DataFrame, threshold: int = 20) -> DataFrame:
    return edges.filter("kind = 'Calls'").groupBy("src").agg(F.count(F.lit(1)).alias("fan_out")).filter(F.col("fan_out") > threshold)


# --- freshness and upkeep ---------------------------------------------------------------------------------------


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) by content hash: New, Changed, Unchanged, Deleted."""
    j = old.select("path", F.col("content_hash").alias("o")).join(new.select("path", F.col("content_hash").alias("n")), "path", "full")
    return j.select("path", F.when(F.col("o").isNull(), "New").when(F.col("n").isNull(), "Deleted").when(F.col("o") == F.col("n"), "Unchanged").otherwise("Changed").alias("state"))


def freshness_cheap(known: DataFrame, files: DataFrame, mode: str = "auto") -> DataFrame:
    """(path, why) of stale documents: missing, and touched after the build ('auto') or of another content ('hash'). known: (path, built_at,
    content_hash); files: (path, mtime, content_hash). 'off' looks at nothing."""
    if mode == "off":
        return known.select("path", F.lit("unknown").alias("why")).limit(0)
    j = known.join(files.select("path", "mtime", F.col("content_hash").alias("now")), "path", "left")
    stale = F.col("mtime") > F.col("built_at")
    if mode == "hash":
        stale = stale & (F.col("now") != F.col("content_hash"))
    return j.select("path", F.when(F.col("mtime").isNull(), "missing").when(stale, "touched").alias("why")).filter("why IS NOT NULL")


def freshness_full(old: dict[str, str], new: dict[str, str], old_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """(mismatch, path) over the identity (old and new: workspace, sdk, compiler, extractor, tfm, graph) and the documents."""
    spark = old_docs.sparkSession
    names = {"workspace": "workspace_mismatch", "sdk": "sdk_mismatch", "compiler": "compiler_mismatch", "extractor": "extractor_mismatch", "tfm": "tfm_mismatch", "graph": "project_graph_mismatch", "adapters": "adapters_mismatch"}
    head = [(names[k], None) for k in names if old.get(k) != new.get(k)]
    d = detect_changes(old_docs, new_docs).filter("state <> 'Unchanged'")
    kind = F.when(F.col("state") == "New", "document_added").when(F.col("state") == "Deleted", "document_removed").otherwise("document_changed")
    return spark.createDataFrame(head, "mismatch string, path string").unionByName(d.select(kind.alias("mismatch"), "path"))


def latest_snapshot(snapshots: DataFrame, status: str = "complete") -> DataFrame:
    """The newest snapshot of a status in each workspace; ties by the greater id."""
    best = snapshots.filter(F.col("status") == status).groupBy("workspace_id").agg(F.max(F.struct("built_at", "snapshot_id")).alias("b"))
    return best.select("workspace_id", "b.snapshot_id", "b.built_at")


def prune_keep_n(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """Snapshots beyond the `keep` newest of their workspace, of whatever status."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("built_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("r", F.row_number().over(w)).filter(F.col("r") > keep).drop("r")


def snapshot_gc(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, action): failed ones become tombstones without payload, unfinished ones go."""
    return snapshots.filter("status <> 'complete'").select("snapshot_id", F.when(F.col("status") == "failed", "tombstone").otherwise("delete").alias("action"))


def copy_forward(facts: DataFrame, snapshot_id: str) -> DataFrame:
    return facts.withColumn("snapshot_id", F.lit(snapshot_id))


def retire(facts: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Facts without those of the keys; a fact whose key is null stays. The keys are written first: with their size known, few of them are sent to the facts, which stay where they are."""
    return facts.join(materialise(keys.select(F.col(keys.columns[0]).alias("__k")).distinct()), F.col(on) == F.col("__k"), "left_anti")


def retire_null_path(edges: DataFrame, assemblies: list[str]) -> DataFrame:
    """Edges without those that have no document and start in one of the assemblies."""
    return edges.filter(~(F.col("doc").isNull() & F.substring_index("src", "|", -1).isin(assemblies)))


def refresh_edges(previous: DataFrame, scope: DataFrame, derived: DataFrame) -> DataFrame:
    """The previous edges without those of the documents in scope (doc), and those derived anew there."""
    return retire(previous, scope, "doc").unionByName(derived.join(scope.select("doc").distinct(), "doc", "left_semi").select(*previous.columns))


def refresh_deduplicated(previous: DataFrame, raw: DataFrame, scope: DataFrame) -> DataFrame:
    """The deduplicated edges `previous`, after the evidence of the documents in scope (doc) has changed to what `raw` has of it.

    Edges that such a document has, or had, evidence of come from all their evidence; the others are taken as they are. Each side is dealt by key once and
    sorted, and one full join takes an edge from either.
    """
    docs = materialise(scope.select("doc").distinct())
    has = raw.join(docs, "doc", "left_semi").select(*KEY).distinct().withColumn("has", F.lit(True))
    rest = [c for c in previous.columns if c not in KEY]
    anew = edge_dedup(raw, KEY).select(*KEY, F.struct(*rest).alias("n")).join(has, KEY, "left")
    had = previous.join(docs.withColumn("had", F.lit(True)), "doc", "left").select(*KEY, F.struct(*rest).alias("p"), "had")
    touched = F.coalesce("has", "had", F.lit(False)) & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("kind").isNotNull()  # a key with nulls equals none
    j = had.join(anew, KEY, "full").select(*KEY, F.when(touched, F.col("n")).otherwise(F.col("p")).alias("e")).filter("e IS NOT NULL")
    return j.select(*[c if c in KEY else f"e.{c}" for c in previous.columns])


def prune_removed_symbols(symbols: DataFrame, declared: DataFrame) -> DataFrame:
    """Symbols that no declaration is left of."""
    return symbols.select("symbol_id").join(declared.select("symbol_id").distinct(), "symbol_id", "left_anti")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: the rows of new, and those of old whose key new lacks; of several new rows of a key the greatest seq."""
    best = new.groupBy(*keys).agg(F.max(F.struct("seq", *[c for c in new.columns if c not in {*keys, "seq"}])).alias("b"))
    rows = best.select(*keys, "b.*").select(*new.columns)
    return old.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def first_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a key that with the least seq."""
    best = rows.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in rows.columns if c not in {*keys, "seq"}])).alias("b"))
    return best.select(*keys, "b.*").select(*rows.columns)


def upsert_extractors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, version): other versions of a new name go, what isn't there comes."""
    return old.join(new.select("name").distinct(), "name", "left_anti").unionByName(new.select(*old.columns).distinct())


def has_stale_extractors(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Extractor versions of edges (extractor, version) that aren't registered, and how many edges have them."""
    return edges.groupBy("extractor", "version").agg(F.count(F.lit(1)).alias("edges")).join(registered.select(F.col("name").alias("extractor"), "version"), ["extractor", "version"], "left_anti")
