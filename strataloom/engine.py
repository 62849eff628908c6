"""The modes of the engine over one store: build, refresh, and the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cursors import decode_cursor, encode_cursor, fingerprint
from .functions.text import token_estimate
from .operators import aggregate, capsule, change, graph, retrieval, search
from .schemas import DOCUMENT
from .sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, workspace_id: str):
        self.spark, self.store, self.workspace = spark, Store(spark, root), workspace_id

    def table(self, name: str, snapshot_id: str | None = None) -> DataFrame:
        s = snapshot_id or (self.store.latest(self.workspace) or {}).get("snapshot_id")
        if s is None:
            raise LookupError("there is no complete snapshot")
        return self.store.read(name, s)

    def _publish(self, snapshot_id: str, symbols: DataFrame, raw_edges: DataFrame, nodes: DataFrame | None, keep: int, facts: dict[str, DataFrame]) -> dict:
        known = symbols.select("symbol_id") if nodes is None else symbols.select("symbol_id").union(nodes.select("symbol_id")).distinct()
        kept, dropped = graph.split_orphans(graph.edge_dedup(raw_edges), known)
        tables = {"symbols": symbols, "raw_edges": raw_edges, "edges": kept, **({} if nodes is None else {"nodes": nodes.select("symbol_id")}), **facts}
        m = self.store.publish(snapshot_id, self.workspace, tables, dropped={r.dropped: r.edges for r in graph.orphan_summary(dropped).collect()})
        self.store.prune(keep)
        return m

    def build(self, snapshot_id: str, symbols: DataFrame, raw_edges: DataFrame, nodes: DataFrame | None = None, keep: int = 3, **facts: DataFrame) -> dict:
        """Edges are deduplicated and those without both ends dropped; then all is published and old snapshots go.

        nodes (symbol_id): ends of edges that no declaration has, like routes.
        """
        return self._publish(snapshot_id, symbols, raw_edges, nodes, keep, facts)

    def refresh(self, snapshot_id: str, symbols: DataFrame, scope: DataFrame, raw_edges: DataFrame, nodes: DataFrame | None = None, keep: int = 3, **facts: DataFrame) -> dict:
        """As a build of all, from the former snapshot and what was extracted anew for the documents in scope (doc).

        The edges before deduplication are kept with the snapshot, so an edge whose best evidence goes falls back on the next best. Facts that belong to documents
        are copied forward but for those of the scope, in whose place the given ones come; other tables are copied whole unless they are
        given. Synthetic nodes of the former snapshot stay, and those given are added.
        """
        last = self.store.latest(self.workspace)
        if last is None:
            return self._publish(snapshot_id, symbols, raw_edges, nodes, keep, facts)
        former = {t: self.store.read(t, last["snapshot_id"]) for t in last["tables"]}
        known = former.pop("nodes", None)
        if known is not None and nodes is not None:
            nodes = known.union(nodes.select("symbol_id")).distinct()
        raw = change.refresh_edges(former["raw_edges"], scope, raw_edges)
        carried = {}
        for t, df in former.items():
            if t in DOCUMENT and t not in {"symbols", "raw_edges", "edges"}:
                rest = change.retire(df, scope, DOCUMENT[t])
                carried[t] = rest.unionByName(facts[t].select(*rest.columns)) if t in facts else rest
            elif t not in {"symbols", "raw_edges", "edges"}:
                carried[t] = facts.get(t, df)
        return self._publish(snapshot_id, symbols, raw, known if nodes is None else nodes, keep, facts | carried)

    def impact(self, symbol: str, downstream: bool = True, kinds: list[str] | None = None, max_depth: int = 3, max_paths: int = 50, cursor: str | None = None) -> dict:
        """Groups of all paths, one page of them, how many are left and where the next page begins."""
        s = self.store.latest(self.workspace)["snapshot_id"]
        request = fingerprint(symbol=symbol, down=downstream, kinds=kinds, depth=max_depth)
        offset = (decode_cursor(cursor, "impact", s, request) or [0])[0] if cursor else 0
        paths = graph.trace_impact(self.table("edges"), [symbol], downstream, kinds, max_depth)
        groups = graph.impact_groups(paths).orderBy(F.desc("paths"), "first_node", "first_kind").collect()
        total = sum(g.paths for g in groups)
        page = graph.path_order(paths).filter((F.col("rank") > offset) & (F.col("rank") <= offset + max_paths)).orderBy("rank").collect()
        left = max(0, total - offset - len(page))
        return {"groups": groups, "paths": page, "total": total, "remaining": left, "cursor": encode_cursor("impact", s, request, [offset + len(page)]) if left else None}

    def diff(self, a: str, b: str) -> dict[str, DataFrame]:
        s = [self.table("symbols", x) for x in (a, b)]
        return {"symbols": change.diff_symbols(*s).filter("change <> 'common'"), "names": change.diff_rename_move(*s), "metadata": change.diff_metadata(*s, ["accessibility", "is_abstract", "type_kind"]), "edges": change.diff_edges(self.table("edges", a), self.table("edges", b))}

    def audit(self, checks: tuple[str, ...] = ("dead", "untested", "unregistered", "fan_out"), fan_out: int = 20) -> dict[str, DataFrame]:
        e, s = self.table("edges"), self.table("symbols")
        run = {"dead": lambda: change.audit_dead(e, s), "untested": lambda: change.audit_untested(e, s), "unregistered": lambda: change.audit_unregistered(e, s), "fan_out": lambda: change.audit_fan_out(e, fan_out)}
        return {c: run[c]() for c in checks}

    def simulate(self, what: str, symbol: str) -> DataFrame:
        return {"rename": change.simulate_rename, "move": change.simulate_move, "remove": change.simulate_remove}[what](self.table("edges"), symbol)

    def context(self, symbol: str, budget: int = 8000) -> dict:
        """The bundle: tiers up to the budget less a reserve of a quarter, 500 at most; an unknown symbol leaves every tier unresolved."""
        order = capsule.tier_order(symbol.startswith("T:"))
        e, s = self.table("edges"), self.table("symbols")
        head = s.filter(F.col("symbol_id") == symbol).select("symbol_id", "fqn").first()
        if head is None:
            return {"anchor": None, "tiers": {t: [] for t in order}, "reasons": {t: "unresolved" for t in order}}
        items = capsule.all_tiers(e, s, symbol).withColumn("cost", token_estimate(F.coalesce("fqn", "symbol_id")))
        used = len(head.fqn or "") // 4
        cut = capsule.budget_prefix(items, budget - min(budget // 4, 500), used)
        rows = cut.filter("included").orderBy("tier_rank", "item_rank").collect()
        reasons = {r.tier: r.reason for r in capsule.tier_reasons(cut, order).collect()}
        out = {"anchor": {"symbol": symbol, "source": head.fqn}, "tiers": {t: [{"symbol": r.symbol_id, "provenance": r.provenance, "source": r.fqn} for r in rows if r.tier == t] for t in order}, "reasons": reasons}
        return capsule.budget_enforce(out, budget, order)

    def find_symbol(self, name: str) -> DataFrame:
        s = self.table("symbols")
        if "|" in name:
            return s.filter(F.col("symbol_id") == name).select("symbol_id", "fqn")
        if name[:2] in {f"{k}:" for k in "TMPEFN"}:
            return retrieval.resolve_doc_id(s, name)
        return retrieval.resolve_fqn(s, name)

    def search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return search.search_symbols(self.table("symbols"), query, kind, limit)

    def annotate(self, snapshot_id: str, symbol: str, kind: str, value: str) -> dict:
        """A new snapshot that has all tables of the last one and the annotation."""
        last = self.store.latest(self.workspace)
        facts = {t: self.store.read(t, last["snapshot_id"]) for t in last["tables"]}
        row = self.spark.createDataFrame([(0, symbol, kind, value, None)], "seq bigint, symbol_id string, kind string, value string, document_path string")
        facts["annotations"] = facts["annotations"].unionByName(row) if "annotations" in facts else row
        return self.store.publish(snapshot_id, self.workspace, facts)

    def status(self) -> dict:
        m = self.store.latest(self.workspace)
        out = {"snapshot": m, "failure": self.store.latest_failure(self.workspace)}
        if m and "incompleteness" in m["tables"]:
            out["completeness"] = aggregate.completeness_summary(self.table("incompleteness")).collect()
        return out
