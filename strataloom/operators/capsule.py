"""Context bundles: tiers of related symbols about an anchor, cut to a budget of tokens."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .graph import among, by_kind, reachable


def compose_provenance(parts: str | Column) -> Column:
    """Of an array of provenances: framework_derived where any is, else possible."""
    c = F.col(parts) if isinstance(parts, str) else parts
    return F.when(F.exists(c, lambda p: p == "framework_derived"), "framework_derived").otherwise("possible")


def _tier(df: DataFrame, node: str, name: str) -> DataFrame:
    best = df.groupBy(F.col(node).alias("symbol_id")).agg(F.min("provenance").alias("provenance"))
    return best.select(F.lit(name).alias("tier"), "symbol_id", "provenance")


def tier_contracts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return _tier(among(by_kind(edges, ["Inherits", "Implements", "Overrides"]), "src", ids), "dst", "contracts")


def tier_direct_callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """What the anchor calls or constructs, and the implementations that the called members may dispatch to."""
    direct = materialise(among(by_kind(edges, ["Calls", "Constructs"]), "src", ids).select("dst", "provenance"))
    more = among(edges.filter("kind = 'MayDispatchTo'"), "src", direct.select("dst")).select("dst", F.lit("global_implementation_relation").alias("provenance"))
    return _tier(direct.unionByName(more.join(direct.select("dst"), "dst", "left_anti")), "dst", "directCallees")


def tier_direct_callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Who calls the anchor, who calls what dispatches to it (its provenance composed), and its entry points."""
    into = materialise(among(by_kind(edges, ["Calls", "MayDispatchTo", "RoutesTo", "Handles"]), "dst", ids).select("src", "kind", "provenance"))
    calls = by_kind(into, ["Calls"]).select("src", "provenance")
    dispatch = into.filter("kind = 'MayDispatchTo'").select(F.col("src").alias("m"), F.col("provenance").alias("p0"))
    near = among(edges.filter("kind = 'Calls'"), "dst", dispatch.select("m"))
    via = near.join(dispatch, F.col("dst") == F.col("m")).select("src", compose_provenance(F.array("p0", "provenance")).alias("provenance"))
    entry = by_kind(into, ["RoutesTo", "Handles"]).select("src", "provenance")
    rest = via.join(calls.select("src"), "src", "left_anti").unionByName(entry.join(calls.select("src"), "src", "left_anti"))
    return _tier(calls.unionByName(rest), "src", "directCallers")


def tier_registered_impls(edges: DataFrame, ids: DataFrame) -> DataFrame:
    into = among(by_kind(edges, ["MayDispatchTo", "Registers"]), "dst", ids).select(F.col("src").alias("n"), "provenance")
    out = among(by_kind(edges, ["MayDispatchTo", "Handles", "Registers"]), "src", ids).select(F.col("dst").alias("n"), "provenance")
    return _tier(into.unionByName(out), "n", "registeredImplementations")


def callers(edges: DataFrame, ids: DataFrame, max_hops: int = 3) -> DataFrame:
    """(node, depth): the ids and who calls them within max_hops."""
    return reachable(by_kind(edges, ["Calls"]), ids.select(F.col("id").alias("node")), downstream=False, max_depth=max_hops)


def tier_relevant_tests(edges: DataFrame, ids: DataFrame, max_hops: int = 3, near: DataFrame | None = None) -> DataFrame:
    """Tests of the anchor and of its callers within max_hops; near: these, where they are known."""
    near = callers(edges, ids, max_hops) if near is None else near
    return _tier(among(edges.filter("kind = 'TestedBy'"), "src", near.select("node")), "dst", "relevantTests")


def tier_second_degree(edges: DataFrame, ids: DataFrame, max_hops: int = 3, near: DataFrame | None = None) -> DataFrame:
    """Callers at two steps to max_hops; none where max_hops is 1."""
    near = callers(edges, ids, max_hops) if near is None else near
    return _tier(near.filter("depth > 1").select("node", F.lit("possible").alias("provenance")), "node", "secondDegree")


def tier_surrounding(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Members of the anchor and of the type that declares it, without itself."""
    own = by_kind(edges, ["Declares", "Contains"])
    parents = materialise(among(own, "dst", ids).select(F.col("src").alias("p")).union(ids.select("id")).distinct())
    return _tier(among(own, "src", parents).join(F.broadcast(ids), F.col("dst") == F.col("id"), "left_anti"), "dst", "surroundingSource")


TIERS = {
    "contracts": tier_contracts,
    "directCallees": tier_direct_callees,
    "directCallers": tier_direct_callers,
    "registeredImplementations": tier_registered_impls,
    "relevantTests": tier_relevant_tests,
    "secondDegree": tier_second_degree,
    "surroundingSource": tier_surrounding,
}


def tier_order(type_anchor: bool = False) -> list[str]:
    """Tiers from the most wanted on; a type's siblings come before its tests."""
    order = list(TIERS)
    if type_anchor:
        i, j = order.index("relevantTests"), order.index("surroundingSource")
        order[i], order[j] = order[j], order[i]
    return order


def all_tiers(edges: DataFrame, symbols: DataFrame, anchor: str) -> DataFrame:
    """(tier, tier_rank, item_rank, symbol_id, fqn, provenance): a symbol counts for the first tier that has it; in a tier by name.

    Callers are searched once for the tiers that need them. The items are written: budgets read them several times.
    """
    ids = edges.sparkSession.range(1).select(F.lit(anchor).alias("id"))
    order = tier_order(anchor.startswith("T:"))
    near, out = callers(edges, ids), None
    for rank, name in enumerate(order):
        t = (TIERS[name](edges, ids, near=near) if name in ("relevantTests", "secondDegree") else TIERS[name](edges, ids)).withColumn("tier_rank", F.lit(rank))
        out = t if out is None else out.unionByName(t)
    first = materialise(out.groupBy("symbol_id").agg(F.min(F.struct("tier_rank", "tier", "provenance")).alias("b")).select("symbol_id", "b.*"))
    w = Window.partitionBy("tier_rank").orderBy("symbol_id")
    names = symbols.select("symbol_id", "fqn").join(first.select("symbol_id"), "symbol_id", "left_semi")
    return materialise(first.join(names, "symbol_id", "left").withColumn("item_rank", F.row_number().over(w)))


def budget_prefix(items: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """items (tier_rank, item_rank, cost …) with `running` and `included`: the longest prefix whose cost, with what is used already, fits.

    The running sum is taken in two steps, within tiers and over the tiers before, so that no single partition holds all items.
    """
    inside = F.sum("cost").over(Window.partitionBy("tier_rank").orderBy("item_rank").rowsBetween(Window.unboundedPreceding, 0))
    totals = items.groupBy("tier_rank").agg(F.sum("cost").alias("t"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.tier_rank") < F.col("a.tier_rank"), "left").groupBy("a.tier_rank").agg(F.coalesce(F.sum("b.t"), F.lit(0)).alias("before"))
    running = (F.col("before") + F.col("inside") + used).alias("running")
    return items.withColumn("inside", inside).join(before, "tier_rank").select(*items.columns, running).withColumn("included", F.col("running") <= budget)


def tier_reasons(budgeted: DataFrame, order: list[str]) -> DataFrame:
    """(tier, included, reason): budget_exhausted where items were left out, empty where there are none, else null."""
    spark = budgeted.sparkSession
    all_ = spark.createDataFrame([(t,) for t in order], "tier string")
    n = budgeted.groupBy("tier").agg(F.sum(F.col("included").cast("int")).alias("included"), F.count(F.lit(1)).alias("items"))
    reason = F.when(F.col("items").isNull(), "empty").when(F.col("included") < F.col("items"), "budget_exhausted")
    return all_.join(n, "tier", "left").select("tier", F.coalesce("included", F.lit(0)).alias("included"), reason.alias("reason"))


def tier_page(items: DataFrame, tier: str, offset: int, limit: int) -> DataFrame:
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    return items.filter((F.col("tier") == tier) & (F.col("item_rank") > offset) & (F.col("item_rank") <= offset + limit))


def artifact_estimate(capsule: dict) -> int:
    """Tokens of the serialised bundle, counting its own figure: a fixed point after four rounds at most."""
    size = 0
    for _ in range(4):
        new = len(json.dumps(capsule | {"tokens": size})) // 4
        if new == size:
            break
        size = new
    return size


def budget_enforce(capsule: dict, budget: int, order: list[str], item_chars: int = 800, paths: int = 3, hops: int = 3) -> dict:
    """Cuts a collected bundle until it fits: bounds the paths, then the items' sources, then empties tiers from the last on, at last the anchor's source.

    Each cut leaves one record in `dropped`.
    """
    c = json.loads(json.dumps(capsule)) | {"dropped": []}

    def fits() -> bool:
        return artifact_estimate(c) <= budget

    def record(what: str) -> None:
        if what not in c["dropped"]:
            c["dropped"].append(what)

    if not fits() and (len(c.get("paths", [])) > paths or any(len(p) > hops for p in c.get("paths", []))):
        c["paths"] = [p[:hops] for p in c["paths"][:paths]]
        record("paths")
    if not fits():
        for t in c.get("tiers", {}).values():
            for item in t:
                if len(item.get("source") or "") > item_chars:
                    item["source"] = item["source"][:item_chars]
                    record("itemSource")
    for name in reversed(order):
        if fits():
            break
        if c.get("tiers", {}).get(name):
            c["tiers"][name] = []
            record(name)
    if not fits() and c.get("anchor", {}).get("source"):
        record("anchorSource")
        room = max(0, 4 * (budget - artifact_estimate(c | {"anchor": c["anchor"] | {"source": ""}})) - 8)
        c["anchor"]["source"] = c["anchor"]["source"][:room]
    return c


def uncertainties(edges: DataFrame, incompleteness: DataFrame, ids: DataFrame) -> DataFrame:
    """(rule, edges or occurrences): what makes statements about the ids doubtful, one row for each rule that applies."""
    out = among(edges, "src", ids)
    rules = {"reflection": F.col("kind").startswith("Reflection"), "dispatch": F.col("kind") == "MayDispatchTo", "missing_receiver": (F.col("kind") == "Calls") & F.col("type_args").isNull(), "convention": F.col("provenance") == "convention", "possible": F.col("provenance") == "possible", "cross_generated": F.col("cross_generated")}
    rows = out.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    inc = incompleteness.agg(F.sum("occurrences").alias("n")).filter("n > 0").select(F.lit("incompleteness").alias("rule"), "n")
    return rows.unionByName(inc)


def suggested_verification(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(command): a test run for each test of the ids; the whole suite where their tests lie in three assemblies or more."""
    t = among(edges.filter("kind = 'TestedBy'"), "src", ids).select("dst").distinct().withColumn("a", F.substring_index("dst", "|", -1))
    many = t.agg(F.count_distinct("a").alias("n"))
    one = t.crossJoin(F.broadcast(many)).select(F.when(F.col("n") >= 3, F.lit("test --all")).otherwise(F.concat(F.lit("test "), "dst")).alias("command"))
    return one.distinct()


def anchor_region_lost(incompleteness: DataFrame, documents: DataFrame, reasons: list[str]) -> DataFrame:
    """(path): the anchor's documents (path) of which something couldn't be observed, by one of the reasons."""
    lost = incompleteness.filter(F.col("reason").isin(reasons)).select(F.col("document_path").alias("path"))
    return documents.select("path").distinct().join(lost, "path", "left_semi")


def change_sites(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, rank): where a change of the ids is felt: 0 their own sites, 1 those of callers, 2 those of implementers and overriders."""
    own = among(edges, "src", ids).select("doc", F.lit(0).alias("rank"))
    into = among(edges, "dst", ids)
    near = into.filter(F.col("kind").isin("Calls", "Constructs", "Reads")).select("doc", F.lit(1).alias("rank"))
    far = into.filter(F.col("kind").isin("Implements", "Overrides", "Registers", "Inherits")).select("doc", F.lit(2).alias("rank"))
    return own.unionByName(near).unionByName(far).filter("doc IS NOT NULL").groupBy("doc").agg(F.min("rank").alias("rank"))
