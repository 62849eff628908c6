"""Queries by name over the projected tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import adapters, aggregate, capsule, change, extract, graph, retrieval, search
from ..sources import sinks
from ..sources.project import ctes, project, table
from ..streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables and projections of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "edges":
            return graph.edge_dedup(self.raw_edges)
        if name == "keyed_edges":
            return graph.edge_dedup(self.raw_edges, graph.KEY)
        if name == "links":
            return graph.links(self.raw_edges)
        if name == "decls":
            return retrieval.declarations(self.turns)
        if name == "conv_docs":
            return retrieval.sources(self.turns)
        from ..sources.project import PROJECTIONS

        return project(self.spark, self.dir, name) if name in PROJECTIONS else table(self.spark, self.dir, name)


def query(name: str, needs: str = "", sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = f"{ctes(*needs.split())} {sql}" if needs else sql
        return f

    return add


def queries() -> dict:
    from . import extraction  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extraction  # noqa: F401

    return dict(SQL)


CUST, NATION, ORDER, PART, SUPP = "T:cust.1|crm", "T:nation.3|geo", "M:order.7|sales", "T:part.5|inv", "T:supp.2|inv"
EDGE = "src, dst, kind, provenance, doc, line, cross_generated, type_args"
ALIVE = "('Calls', 'References', 'Overrides', 'Implements', 'Registers')"

# --- scans ------------------------------------------------------------------------------------------------------

query("scan_edges", "edges", f"SELECT {EDGE} FROM edges")(lambda t: t.edges)
query("edge_dedup", "edges", f"SELECT {EDGE} FROM edges")(lambda t: graph.edge_dedup(t.raw_edges))
query("scan_edges_touching", "edges", f"SELECT {EDGE} FROM edges WHERE src = '{PART}' OR dst = '{PART}'")(lambda t: graph.edge_dedup(graph.touching(t.raw_edges, PART)))
query("scan_edges_by_kind", "edges", f"SELECT {EDGE} FROM edges WHERE kind = 'Registers'")(lambda t: graph.edge_dedup(graph.by_kind(t.raw_edges, ["Registers"])))
query("neighbors_in", "edges", f"SELECT {EDGE} FROM edges WHERE dst = '{SUPP}'")(lambda t: graph.edge_dedup(graph.neighbors_in(t.raw_edges, SUPP)))
query("neighbors_out", "edges", f"SELECT {EDGE} FROM edges WHERE src = '{CUST}'")(lambda t: graph.edge_dedup(graph.neighbors_out(t.raw_edges, CUST)))
query("edge_kind_filter", "raw_edges", "SELECT kind, provenance, count(*) AS n FROM raw_edges WHERE kind IN ('Calls', 'Reads') GROUP BY kind, provenance")(
    lambda t: graph.by_kind(t.raw_edges, ["Calls", "Reads"]).groupBy("kind", "provenance").agg(F.count(F.lit(1)).alias("n")))
query("count_edges", "raw_edges", "SELECT count(*) AS n FROM (SELECT DISTINCT src, dst, kind FROM raw_edges)")(lambda t: aggregate.count_rows(t.raw_edges.select("src", "dst", "kind").distinct()))
query("count_symbols", "symbols", "SELECT count(*) AS n FROM symbols")(lambda t: aggregate.count_rows(t.symbols))
query("count_diagnostics", "diagnostics", "SELECT count(*) AS n FROM diagnostics")(lambda t: aggregate.count_rows(t.diagnostics))
query("scan_symbols", "symbols", "SELECT symbol_id FROM symbols")(lambda t: t.symbols.select("symbol_id"))
query("scan_diagnostics", "diagnostics", "SELECT * FROM diagnostics WHERE project = 'src3'")(lambda t: t.diagnostics.filter("project = 'src3'").orderBy("seq"))
query("scan_annotations", "annotations", "SELECT seq, symbol_id, kind, value, nullif(document_path, '') AS document_path FROM annotations")(lambda t: t.annotations.withColumn("document_path", F.nullif("document_path", F.lit(""))))
query("scan_incompleteness", "incompleteness", "SELECT project, nullif(document_path, '') AS document_path, reason, occurrences FROM incompleteness")(lambda t: t.incompleteness.withColumn("document_path", F.nullif("document_path", F.lit(""))))
query("scan_timings", "timings", "SELECT snapshot_id, step, seq, elapsed FROM timings")(lambda t: t.timings)
query("src_documents", "docs", "SELECT path, project, assembly, strlen(content) AS bytes FROM docs")(lambda t: t.docs.select("path", "project", "assembly", F.octet_length("content").cast("bigint").alias("bytes")))
query("src_diagnostics", "diagnostics", "SELECT severity, count(*) AS n FROM diagnostics GROUP BY severity")(lambda t: t.diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n")))
query("distinct_projects", "docs", "SELECT DISTINCT project FROM docs")(lambda t: t.docs.select("project").distinct())


@query("scan_normalize_bytes", "docs", "SELECT path, sha256(content) AS h FROM docs")
def _(t):
    c = F.col("content")
    raw = F.when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(c, "UTF-16LE"))).when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(c, "UTF-16BE"))).when(F.col("doc_id") % 4 == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(c, "UTF-8"))).otherwise(F.encode(c, "UTF-8"))
    return t.docs.withColumn("raw", raw).select("path", F.sha2(fx.normalize_bytes("raw"), 256).alias("h"))


IGNORE = ["*.g.cs", "de/**", "!de/src1?/", "src7/"]
query("scan_ignore_filter", "docs", r"SELECT path FROM docs WHERE NOT (CASE WHEN regexp_matches(path, '(^|/)src7/') THEN true WHEN regexp_matches(path, '^de/src1[^/]/') THEN false WHEN regexp_matches(path, '^de/.*') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\.g\.cs(/|$)') THEN true ELSE false END)")(
    lambda t: t.docs.filter(~fx.is_ignored("path", IGNORE)).select("path"))
query("scan_build_output_filter", "docs", "SELECT path FROM docs WHERE project NOT IN ('src3', 'src5')")(
    lambda t: t.docs.withColumn("p", F.concat(F.when(F.col("project") == "src3", "a/obj/").when(F.col("project") == "src5", "Bin/").otherwise("a/objx/"), "path")).filter(~fx.is_build_output("p")).select("path"))
query("scan_generated_flag", "docs", "SELECT path, path LIKE '%.g.cs' AS generated FROM docs")(lambda t: t.docs.select("path", fx.is_generated("path", "content").alias("generated")))
query("generator_identity", "docs", "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'tool ' || project WHEN doc_id % 3 = 1 THEN 'made by ' || project END AS generator FROM docs")(
    lambda t: t.docs.select("path", fx.generator_identity(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[GeneratedCode("tool '), "project", F.lit('", "1")]'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("// <auto-generated> made by "), "project", F.lit("\n"))).otherwise(F.lit("")), F.regexp_replace("content", "[<\"]", ""))).alias("generator")))
query("line_starts", "docs", """, l AS (SELECT path, content, unnest(string_split(content, chr(10))) AS line, unnest(range(0, len(string_split(content, chr(10))))) AS i FROM docs),
s AS (SELECT path, content, i, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
SELECT path, string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS starts FROM s WHERE i = 0 OR pos < strlen(content) GROUP BY path""")(
    lambda t: t.docs.select("path", F.array_join(F.transform(fx.line_starts("content"), lambda x: x.cast("string")), ",").alias("starts")))
query("content_hash", "docs", "SELECT path, sha256(content) AS content_hash, path || ':' || sha256(content) AS version_id, strlen(content) AS byte_count FROM docs")(lambda t: retrieval.document_versions(t.docs).withColumn("byte_count", F.col("byte_count").cast("bigint")))
query("snapshot_id", "docs", "SELECT substr(sha256('ws' || chr(10) || 'sdk' || chr(10) || string_agg(path || ':' || sha256(content), chr(10) ORDER BY path || ':' || sha256(content))), 1, 32) AS snapshot_id FROM docs")(lambda t: aggregate.snapshot_identity(retrieval.document_versions(t.docs), ["ws", "sdk"]))
query("src_project_tfm", "", "SELECT DISTINCT source AS project, 'net' || lang AS tfm FROM documents")(
    lambda t: t.documents.select("source", "lang").distinct().select(F.col("source").alias("project"), F.expr("xpath_string(concat('<Project><PropertyGroup><TargetFramework>net', lang, '</TargetFramework></PropertyGroup></Project>'), 'Project/PropertyGroup/TargetFramework')").alias("tfm")))
query("src_project_graph", "", "SELECT lang AS project, string_agg(DISTINCT source, ',' ORDER BY source) AS referenced FROM documents GROUP BY lang")(lambda t: aggregate.project_graph(t.documents.select(F.col("lang").alias("project"), F.col("source").alias("referenced"))))
query("load_gate", "docs", "SELECT project, path AS document_path, 'project_unreadable' AS reason FROM docs WHERE project IN ('src2', 'src4')")(
    lambda t: aggregate.load_gate(t.docs, t.docs.select("project").distinct().withColumn("readable", ~F.col("project").isin("src2", "src4"))))

# --- snapshots --------------------------------------------------------------------------------------------------

_latest = "SELECT workspace_id, snapshot_id, built_at FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY built_at DESC, snapshot_id DESC) AS rn FROM snapshots WHERE status = '{}') x WHERE rn = 1"
query("latest_snapshot", "snapshots", _latest.format("complete"))(lambda t: change.latest_snapshot(t.snapshots))
query("latest_failure", "snapshots", _latest.format("failed"))(lambda t: change.latest_snapshot(t.snapshots, "failed"))
query("snapshot_metadata", "snapshots", "SELECT snapshot_id, workspace_id, built_at, status, failure_reason FROM snapshots WHERE workspace_id = 'w3'")(lambda t: t.snapshots.filter("workspace_id = 'w3'"))
query("prune_keep_n", "snapshots", "SELECT snapshot_id, workspace_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY built_at DESC, snapshot_id DESC) AS rn FROM snapshots) x WHERE rn > 3")(lambda t: change.prune_keep_n(t.snapshots).select("snapshot_id", "workspace_id"))
query("snapshot_gc", "snapshots", "SELECT snapshot_id, CASE status WHEN 'failed' THEN 'tombstone' ELSE 'delete' END AS action FROM snapshots WHERE status <> 'complete'")(lambda t: change.snapshot_gc(t.snapshots))
query("copy_forward", "annotations", "SELECT *, 'next' AS snapshot_id FROM annotations")(lambda t: change.copy_forward(t.annotations, "next"))

# --- retrieval --------------------------------------------------------------------------------------------------

query("get_source", "docs", "SELECT path, content FROM docs WHERE path = 'en/src7/7.txt'")(lambda t: retrieval.get_source(t.docs, "en/src7/7.txt"))
query("doc_versions_by_path", "docs", "SELECT path, path || ':' || sha256(content) AS version_id FROM docs")(lambda t: retrieval.document_versions(t.docs).select("path", "version_id"))
query("doc_versions_for_documents", "docs", "SELECT path, path || ':' || sha256(content) AS version_id FROM docs WHERE project IN ('src1', 'src2')")(
    lambda t: retrieval.document_versions(retrieval.documents_of(t.docs, t.docs.filter("project IN ('src1', 'src2')"))).select("path", "version_id"))
query("symbol_info", "symbols decls", "SELECT s.symbol_id, fqn, count(d.path) AS decl_count, count(d.path) > 1 AS is_partial FROM (SELECT symbol_id, fqn FROM symbols UNION ALL SELECT DISTINCT symbol_id, 'chat.' || symbol_id FROM decls) s LEFT JOIN decls d ON s.symbol_id = d.symbol_id GROUP BY s.symbol_id, fqn")(
    lambda t: retrieval.symbol_info(t.symbols.select("symbol_id", "fqn").union(t.turns.select("symbol_id", F.concat(F.lit("chat."), "symbol_id")).distinct()), t.decls))
query("symbol_view", "turns", "SELECT symbol_id, nullif(text, '') AS view FROM turns")(lambda t: retrieval.symbol_view(t.decls, t.conv_docs))
query("containing_type_view", "turns", "SELECT symbol_id, 'T:conv.' || CAST(conv_id AS VARCHAR) || '|chat' AS type_id FROM turns")(lambda t: t.turns.select("symbol_id", fx.containing_type("symbol_id").alias("type_id")))
query("declaration_locations", "decls", "SELECT symbol_id, path, CAST(coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line, 0 AS \"column\" FROM decls")(lambda t: retrieval.declaration_locations(t.decls, t.conv_docs))
query("surrounding_lines", "decls", """, lines AS (SELECT path, turn, symbol_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM decls),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY turn, k) AS i FROM lines),
b AS (SELECT path, symbol_id, min(i) AS a, max(i) AS z FROM n GROUP BY path, symbol_id)
SELECT b.symbol_id, string_agg(n.line, chr(10) ORDER BY n.i) AS text FROM b JOIN n ON n.path = b.path AND n.i BETWEEN b.a - 1 AND b.z + 1 GROUP BY b.symbol_id""")(
    lambda t: retrieval.surrounding_lines(t.decls, t.conv_docs))
_place = "SELECT symbol_id AS place_id, path, full_start + CAST(floor((full_end - full_start) / 2) AS INT) AS \"offset\" FROM decls WHERE full_end > full_start"
query("navigate", "decls", f", p AS ({_place}), h AS (SELECT place_id, d.symbol_id, row_number() OVER (PARTITION BY place_id ORDER BY full_end - full_start, d.symbol_id) AS rn FROM p JOIN decls d ON p.path = d.path AND full_start <= \"offset\" AND \"offset\" < full_end) SELECT place_id, symbol_id FROM h WHERE rn = 1")(
    lambda t: retrieval.navigate(t.decls, t.decls.filter("full_end > full_start").select(F.col("symbol_id").alias("place_id"), "path", (F.col("full_start") + F.floor((F.col("full_end") - F.col("full_start")) / 2).cast("int")).alias("offset"))))
query("resolve_location", "decls", "SELECT path, min(symbol_id) AS symbol_id FROM decls WHERE full_start = 0 AND full_end > 0 GROUP BY path")(
    lambda t: retrieval.navigate(t.decls, t.conv_docs.select(F.col("path").alias("place_id"), "path", F.element_at("line_starts", 1).alias("offset"))).select(F.col("place_id").alias("path"), "symbol_id"))
query("offset_to_line", "decls", "SELECT path, CAST(sum(len(string_split(text, chr(10)))) - 1 AS INTEGER) AS line FROM decls GROUP BY path")(
    lambda t: t.conv_docs.select("path", fx.offset_to_line(fx.line_starts(F.concat("content", F.lit("."))), F.octet_length("content")).alias("line")))
query("resolve_fqn", "symbols", "SELECT symbol_id, fqn FROM symbols WHERE fqn LIKE 'crm.BUILDING.%' ORDER BY fqn, symbol_id LIMIT 1")(lambda t: retrieval.resolve_fqn(t.symbols, "crm.BUILDING."))
query("resolve_doc_id", "symbols", "SELECT symbol_id, fqn FROM symbols WHERE doc_comment_id = 'T:part.9' ORDER BY symbol_id LIMIT 1")(lambda t: retrieval.resolve_doc_id(t.symbols, "T:part.9"))
query("public_surface", "symbols", "SELECT symbol_id, fqn, accessibility FROM symbols WHERE accessibility IN ('Public', 'Protected', 'ProtectedOrInternal')")(lambda t: retrieval.public_surface(t.symbols).select("symbol_id", "fqn", "accessibility"))
_gen = lambda t: t.decls.withColumn("is_generated", F.col("role") == "assistant")
query("filter_generated_document", "decls", "SELECT path FROM decls GROUP BY path HAVING NOT bool_or(role = 'assistant')")(lambda t: retrieval.filter_generated(t.symbols, _gen(t), "document"))
query("filter_generated_keep", "decls symbols", "SELECT symbol_id FROM symbols UNION ALL SELECT symbol_id FROM decls GROUP BY symbol_id HAVING bool_or(role <> 'assistant')")(
    lambda t: retrieval.filter_generated(t.symbols.select("symbol_id").union(t.turns.select("symbol_id").distinct()), _gen(t), "keep"))
query("filter_generated_strict", "decls", "SELECT symbol_id FROM decls GROUP BY symbol_id HAVING bool_or(role <> 'assistant')")(lambda t: retrieval.filter_generated(t.symbols.select("symbol_id").union(t.turns.select("symbol_id").distinct()), _gen(t), "strict"))
query("token_estimate", "docs", "SELECT path, CAST(floor(len(content) / 4) AS INTEGER) AS tokens FROM docs")(lambda t: t.docs.select("path", fx.token_estimate("content").alias("tokens")))

# --- search -----------------------------------------------------------------------------------------------------

_post = r", w AS (SELECT path AS key, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS term FROM docs), p AS (SELECT key, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY key, term), n AS (SELECT path AS key, len(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS length FROM docs)"


def _bm25(terms: str, count: int) -> str:
    return f""", f AS (SELECT * FROM p WHERE term IN ({terms})), df AS (SELECT term, count(*) AS n FROM f GROUP BY term), s AS (SELECT count(*) AS big, avg(length) AS avgl FROM n),
r AS (SELECT f.key, -sum(greatest(ln((big - df.n + 0.5) / (df.n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))) AS rank, count(*) AS hits FROM f JOIN df USING (term) JOIN n USING (key) CROSS JOIN s GROUP BY f.key)
SELECT key AS path, round(rank, 6) AS rank FROM r WHERE hits >= {count}"""


query("build_search_index", "docs", _post + " SELECT key, term, tf FROM p")(lambda t: search.build_search_index(t.docs, "path", ["content"])[0])
query("refresh_search_index", "docs", _post + " SELECT key, term, tf FROM p")(
    lambda t: search.refresh_search_index(*search.build_search_index(t.docs.withColumn("content", F.when(F.col("project") == "src1", "old words").otherwise(F.col("content"))), "path", ["content"]), t.docs.filter("project = 'src1'"), t.docs, "path", ["content"])[0])
query("copy_search_index", "docs", _post + " SELECT key, term, tf, 'next' AS snapshot_id FROM p")(lambda t: search.copy_search_index(search.build_search_index(t.docs, "path", ["content"])[0], "next"))
query("search_source", "docs", _post + _bm25("'license', 'version'", 2) + " ORDER BY rank, path LIMIT 20")(lambda t: search.search_source(t.docs, "license version"))
query("search_bm25_any", "docs", _post + _bm25("'the', 'idiot'", 1))(lambda t: search.bm25(*search.build_search_index(t.docs, "path", ["content"]), "the OR idiot").select(F.col("key").alias("path"), F.round("rank", 6).alias("rank")))
query("search_symbols", "symbols", "SELECT symbol_id, fqn, CAST(0 AS DOUBLE) AS rank FROM symbols WHERE contains(lower(fqn), 'crm.building') ORDER BY symbol_id LIMIT 20")(lambda t: search.search_symbols(t.symbols, "crm.BUILDING"))
query("search_substring", "symbols", "SELECT symbol_id, fqn FROM symbols WHERE contains(lower(fqn), 'brand#1')")(lambda t: search.search_substring(t.symbols, "Brand#1"))
query("keyset_page_substring", "symbols", "SELECT symbol_id, fqn FROM symbols WHERE contains(lower(fqn), 'inv') AND (fqn > 'inv.Brand#2' OR (fqn = 'inv.Brand#2' AND symbol_id > '')) ORDER BY fqn, symbol_id LIMIT 11")(
    lambda t: search.keyset_page(search.search_substring(t.symbols, "inv"), "fqn", "symbol_id", ("inv.Brand#2", ""), 10))
query("topk_search", "docs", _post + _bm25("'und', 'die'", 2) + " ORDER BY rank, path LIMIT 5")(lambda t: search.search_source(t.docs, "und die", 5))
_plain = r"regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g')"
query("snippet", "docs", rf", x AS (SELECT path, regexp_split_to_array(content, '\s+') AS ws FROM docs WHERE contains(lower(content), 'license')), y AS (SELECT path, ws, coalesce(list_position(list_transform(ws, lambda w: {_plain}), 'license'), 1) AS hit FROM x), z AS (SELECT path, ws, CASE WHEN hit = 0 THEN 1 ELSE hit END AS hit FROM y) SELECT path, array_to_string(list_transform(ws[greatest(hit - 5, 1) : greatest(hit - 5, 1) + 10], lambda w: CASE WHEN {_plain} = 'license' THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS snippet FROM z")(
    lambda t: t.docs.filter(F.lower("content").contains("license")).select("path", search.snippet("content", ["license"]).alias("snippet")))
query("offset_page", "symbols", "SELECT symbol_id, (SELECT greatest(count(*) - 30, 0) FROM symbols) AS remaining FROM symbols ORDER BY symbol_id LIMIT 10 OFFSET 20")(lambda t: search.offset_page(t.symbols.select("symbol_id"), ["symbol_id"], 20, 10))

# --- graph ------------------------------------------------------------------------------------------------------


def _paths(seed: str, down: bool, kinds: str | None, depth: int, select: str) -> str:
    here, there = ("src", "dst") if down else ("dst", "src")
    k = f"AND e.kind IN ({kinds})" if kinds else ""
    return f""", p AS (SELECT '{seed}' AS cur, ['{seed}'] AS visited, 0 AS d, '' AS chain, CAST(NULL AS VARCHAR) AS fk, CAST(NULL AS VARCHAR) AS fn, CAST(NULL AS VARCHAR) AS fp
  UNION ALL SELECT e.{there}, list_append(visited, e.{there}), d + 1, chain || '>' || e.kind || ':' || e.{there}, coalesce(fk, e.kind), coalesce(fn, e.{there}), coalesce(fp, e.provenance) FROM p JOIN edges e ON e.{here} = p.cur {k} WHERE d < {depth} AND NOT list_contains(visited, e.{there})),
m AS (SELECT '{seed}' AS seed, chain, d AS steps, d = {depth} AS truncated, fk AS first_kind, fn AS first_node, fp AS first_provenance FROM p WHERE d = {depth} OR (d > 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.{here} = p.cur {k} AND NOT list_contains(p.visited, e.{there}))))
{select}"""


_M = "SELECT seed, chain, steps, truncated, first_kind, first_node, first_provenance FROM m"
query("trace_impact", "edges", _paths(CUST, True, None, 3, _M))(lambda t: graph.trace_impact(t.raw_edges, [CUST], raw=True))
query("trace_impact_kinds", "edges", _paths(CUST, True, "'Declares', 'Calls'", 3, _M))(lambda t: graph.trace_impact(t.raw_edges, [CUST], kinds=["Declares", "Calls"], raw=True))
query("trace_impact_upstream", "edges", _paths(NATION, False, None, 2, _M))(lambda t: graph.trace_impact(t.raw_edges, [NATION], False, max_depth=2, raw=True))
query("impact_groups", "edges", _paths(CUST, True, None, 3, "SELECT seed, first_node, first_kind, count(*) AS paths, max(steps) AS max_steps, min(first_provenance) AS provenance FROM m GROUP BY seed, first_node, first_kind"))(lambda t: graph.impact_groups(graph.trace_impact(t.raw_edges, [CUST], raw=True)))
query("path_order", "edges", _paths(CUST, True, None, 3, "SELECT chain, CAST(row_number() OVER (ORDER BY first_node, first_kind, lpad(CAST(steps AS VARCHAR), 4, '0'), chain) AS INTEGER) AS rank FROM m"))(lambda t: graph.path_order(graph.trace_impact(t.raw_edges, [CUST], raw=True)).select("chain", "rank"))
query("impact_semantic_causes", "edges annotations", _paths(CUST, True, None, 3, "SELECT chain, string_agg(DISTINCT a.kind, ',' ORDER BY a.kind) AS causes FROM m LEFT JOIN annotations a ON a.symbol_id = m.seed GROUP BY chain"))(
    lambda t: graph.trace_impact(t.raw_edges, [CUST], raw=True).join(t.annotations.select("symbol_id", "kind"), F.col("seed") == F.col("symbol_id"), "left").groupBy("chain").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("kind")), ","), F.lit("")).alias("causes")))


def _reach(select: str, seed: str, here: str, there: str, depth: int, kinds: str = "") -> str:
    return f", r AS (SELECT node, min(d) AS depth FROM (WITH RECURSIVE q AS (SELECT '{seed}' AS node, 0 AS d UNION SELECT e.{there}, d + 1 FROM q JOIN (SELECT DISTINCT src, dst FROM edges {kinds}) e ON e.{here} = q.node WHERE d < {depth}) SELECT * FROM q) z GROUP BY node) {select}"


_seed = lambda t, s: t.spark.createDataFrame([(s,)], "node string")
query("reachable", "edges", _reach("SELECT node, depth FROM r", CUST, "src", "dst", 4))(lambda t: graph.reachable(t.raw_edges, _seed(t, CUST), max_depth=4))
query("with_declared_members", "raw_edges symbols", "SELECT symbol_id, symbol_id AS member FROM symbols UNION ALL SELECT DISTINCT src, dst FROM raw_edges WHERE kind = 'Declares'")(lambda t: graph.with_declared_members(graph.by_kind(t.links, ["Declares"]), t.symbols))
_CLOSURE = ", up AS (SELECT DISTINCT src, dst FROM raw_edges WHERE kind IN ('Implements', 'Inherits')), cl AS (SELECT src, dst FROM up UNION SELECT a.src, b.dst FROM up a JOIN up b ON a.dst = b.src UNION SELECT symbol_id, symbol_id FROM symbols)"
query("is_assignable", "raw_edges symbols", _CLOSURE + " SELECT src, dst FROM cl")(lambda t: graph.is_assignable(t.raw_edges, t.symbols))
query("receiver_compatible", "raw_edges symbols", _CLOSURE + " SELECT symbol_id AS id, EXISTS (SELECT 1 FROM cl WHERE cl.src = symbol_id AND cl.dst = 'T:region.1|geo') OR (EXISTS (SELECT 1 FROM cl WHERE cl.src = symbol_id AND cl.dst = 'T:region.2|geo') AND EXISTS (SELECT 1 FROM cl WHERE cl.src = symbol_id AND cl.dst = 'T:nation.8|geo')) AS ok FROM symbols")(
    lambda t: graph.receiver_compatible(graph.is_assignable(t.raw_edges, t.symbols), t.symbols.select(F.col("symbol_id").alias("id"), F.col("symbol_id").alias("type"), F.array(F.array(F.lit("T:region.1|geo")), F.array(F.lit("T:region.2|geo"), F.lit("T:nation.8|geo"))).alias("alternatives"))))
_known = "known AS (SELECT symbol_id FROM symbols WHERE symbol_id NOT LIKE '%3|%')"
_orph = f", {_known}, j AS (SELECT e.*, a.symbol_id IS NOT NULL AS sa, b.symbol_id IS NOT NULL AS sb FROM edges e LEFT JOIN known a ON e.src = a.symbol_id LEFT JOIN known b ON e.dst = b.symbol_id)"
_nodes = lambda t: t.symbols.filter("symbol_id NOT LIKE '%3|%'")
query("delete_orphan_edges", "edges symbols", _orph + " SELECT src, dst, kind FROM j WHERE sa AND sb")(lambda t: graph.split_orphans(t.links, _nodes(t))[0].select("src", "dst", "kind"))
query("orphan_drop_summary", "edges symbols", _orph + " SELECT CASE WHEN split_part(CASE WHEN NOT sa THEN src ELSE dst END, '|', 2) IN ('inv', 'geo') THEN 'external' ELSE 'other' END AS dropped, count(*) AS edges FROM j WHERE NOT (sa AND sb) GROUP BY 1")(lambda t: graph.orphan_summary(graph.split_orphans(t.links, _nodes(t))[1]))
query("project_closure", "", "WITH RECURSIVE r AS (SELECT 'src3' AS project UNION SELECT d.lang FROM documents d JOIN r ON d.source = r.project) SELECT project FROM r")(
    lambda t: graph.project_closure(t.documents.select(F.col("lang").alias("project"), F.col("source").alias("referenced")).distinct(), t.spark.createDataFrame([("src3",)], "project string")))
query("reverse_doc_closure", "raw_edges symbols", ", decl AS (SELECT DISTINCT dst AS symbol_id, doc AS path FROM raw_edges WHERE kind = 'Declares' AND doc IS NOT NULL), s AS (SELECT DISTINCT e.doc AS a, d.path AS b FROM raw_edges e JOIN decl d ON e.dst = d.symbol_id WHERE e.doc IS NOT NULL), r AS (SELECT 'crm/1.cs' AS path UNION SELECT s.a FROM s JOIN r ON s.b = r.path) SELECT path FROM r")(
    lambda t: graph.reverse_doc_closure(t.raw_edges, t.raw_edges.filter("kind = 'Declares' AND doc IS NOT NULL").select(F.col("dst").alias("symbol_id"), F.col("doc").alias("path")).distinct(), t.spark.createDataFrame([("crm/1.cs",)], "path string"), ratio=10.0)[0])
query("fqn_of_endpoint", "edges symbols", "SELECT e.src, e.dst, e.kind, s.fqn AS src_fqn, d.fqn AS dst_fqn FROM edges e LEFT JOIN symbols s ON e.src = s.symbol_id LEFT JOIN symbols d ON e.dst = d.symbol_id")(
    lambda t: t.links.join(t.symbols.select(F.col("symbol_id").alias("a"), F.col("fqn").alias("src_fqn")), F.col("src") == F.col("a"), "left").join(t.symbols.select(F.col("symbol_id").alias("b"), F.col("fqn").alias("dst_fqn")), F.col("dst") == F.col("b"), "left").drop("a", "b"))

# --- aggregates -------------------------------------------------------------------------------------------------

query("completeness_summary", "incompleteness", "SELECT project, reason, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM incompleteness GROUP BY project, reason")(lambda t: aggregate.completeness_summary(t.incompleteness))
query("uncertainty_rollup", "incompleteness", "SELECT reason, CAST(sum(occurrences) AS BIGINT) AS occurrences, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM incompleteness GROUP BY reason")(lambda t: aggregate.uncertainty_rollup(t.incompleteness))
query("timing_summary", "timings", "SELECT step, CAST(sum(elapsed) AS BIGINT) AS elapsed, round(sum(elapsed) * 100.0 / (SELECT sum(elapsed) FROM timings), 1) AS percent FROM timings GROUP BY step")(lambda t: aggregate.timing_summary(t.timings))
query("audit_fan_out", "edges", "SELECT src, count(*) AS fan_out FROM edges WHERE kind = 'Calls' GROUP BY src HAVING count(*) > 5")(lambda t: change.audit_fan_out(t.links, 5))
query("merge_receiver_constraints", "raw_edges", "SELECT src, dst, string_agg(DISTINCT type_arg, ',' ORDER BY type_arg) AS receivers FROM raw_edges WHERE kind = 'Calls' GROUP BY src, dst")(
    lambda t: extract.calls(t.raw_edges.filter("kind = 'Calls'").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(False).alias("is_lambda"), F.col("type_arg").alias("receiver"))).select("src", "dst", "receivers"))
query("extractor_staleness", "raw_edges", "SELECT kind AS extractor, '1.' || CAST(line % 3 AS VARCHAR) AS version, count(*) AS edges FROM raw_edges WHERE line IS NOT NULL AND NOT (line % 3 = 0) GROUP BY ALL")(
    lambda t: change.has_stale_extractors(t.raw_edges.filter("line IS NOT NULL").select(F.col("kind").alias("extractor"), F.concat(F.lit("1."), (F.col("line") % 3).cast("string")).alias("version")), t.raw_edges.select(F.col("kind").alias("name"), F.lit("1.0").alias("version")).distinct()))

# --- diffs ------------------------------------------------------------------------------------------------------

_B = "b AS (SELECT symbol_id, CASE WHEN symbol_id LIKE '%7|%' THEN fqn || 'x' WHEN symbol_id LIKE '%8|%' THEN 'new.' || fqn ELSE fqn END AS fqn, CASE WHEN symbol_id LIKE '%1|%' THEN 'Private' ELSE accessibility END AS accessibility, type_kind FROM symbols WHERE symbol_id NOT LIKE '%4|%'), a AS (SELECT * FROM symbols WHERE symbol_id NOT LIKE '%5|%')"


def _ab(t):
    s = t.symbols
    b = s.filter("symbol_id NOT LIKE '%4|%'").withColumns({"fqn": F.expr("CASE WHEN symbol_id LIKE '%7|%' THEN fqn || 'x' WHEN symbol_id LIKE '%8|%' THEN 'new.' || fqn ELSE fqn END"), "accessibility": F.expr("CASE WHEN symbol_id LIKE '%1|%' THEN 'Private' ELSE accessibility END")})
    return s.filter("symbol_id NOT LIKE '%5|%'"), b


query("diff_symbols", "symbols", f", {_B} SELECT coalesce(a.symbol_id, b.symbol_id) AS symbol_id, CASE WHEN a.symbol_id IS NULL THEN 'added' WHEN b.symbol_id IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b ON a.symbol_id = b.symbol_id")(lambda t: change.diff_symbols(*_ab(t)))
query("diff_rename_move", "symbols", f", {_B} SELECT a.symbol_id, a.fqn AS old, b.fqn AS new, CASE WHEN b.fqn LIKE 'new.%' THEN 'moved' ELSE 'renamed' END AS change FROM a JOIN b ON a.symbol_id = b.symbol_id WHERE a.fqn <> b.fqn")(lambda t: change.diff_rename_move(*_ab(t)))
query("diff_metadata", "symbols", f", {_B} SELECT a.symbol_id, 'accessibility' AS key, a.accessibility AS old, b.accessibility AS new FROM a JOIN b ON a.symbol_id = b.symbol_id WHERE a.accessibility <> b.accessibility")(lambda t: change.diff_metadata(*_ab(t), ["accessibility", "type_kind"]))
query("diff_source", "turns", "SELECT symbol_id, CASE WHEN conv_id % 4 = 0 THEN 'comparison_unavailable' WHEN conv_id % 4 = 1 THEN 'body_only_changed' ELSE 'signature_changed' END AS change FROM turns WHERE conv_id % 4 < 3")(
    lambda t: change.diff_source(t.turns.select("symbol_id", F.col("role").alias("signature"), F.col("text").alias("body")), t.turns.select("symbol_id", F.when(F.col("conv_id") % 4 == 2, F.concat("role", F.lit("!"))).otherwise(F.col("role")).alias("signature"), F.when(F.col("conv_id") % 4 == 0, F.lit(None)).when(F.col("conv_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"))))
_EB = "eb AS (SELECT src, dst, kind, CASE WHEN line % 5 = 0 THEN 'possible' ELSE provenance END AS provenance, doc, CASE WHEN line % 7 = 0 THEN line + 1 ELSE line END AS line, cross_generated, type_args FROM edges WHERE line IS NULL OR line % 11 <> 0), ea AS (SELECT * FROM edges WHERE line IS NULL OR line % 13 <> 0)"


def _edges_ab(t):
    e = t.keyed_edges
    return e.filter("line IS NULL OR line % 13 <> 0"), e.filter("line IS NULL OR line % 11 <> 0").withColumns({"provenance": F.expr("CASE WHEN line % 5 = 0 THEN 'possible' ELSE provenance END"), "line": F.expr("CASE WHEN line % 7 = 0 THEN line + 1 ELSE line END")})


_DIFF = f", {_EB}, j AS (SELECT coalesce(ea.src, eb.src) AS src, coalesce(ea.dst, eb.dst) AS dst, coalesce(ea.kind, eb.kind) AS kind, ea.src IS NULL AS isnew, eb.src IS NULL AS isgone, ea.provenance <> eb.provenance AS ev, ea.line IS DISTINCT FROM eb.line AS lo FROM ea FULL JOIN eb ON ea.src = eb.src AND ea.dst = eb.dst AND ea.kind = eb.kind), diff AS (SELECT src, dst, kind, 'added' AS change FROM j WHERE isnew UNION ALL SELECT src, dst, kind, 'removed' FROM j WHERE isgone UNION ALL SELECT src, dst, kind, 'evidence_changed' FROM j WHERE NOT isnew AND NOT isgone AND ev UNION ALL SELECT src, dst, kind, 'location_changed' FROM j WHERE NOT isnew AND NOT isgone AND lo)"
query("diff_edges", "edges", _DIFF + " SELECT * FROM diff")(lambda t: change.diff_edges(*_edges_ab(t)))
query("diff_scoped", "edges symbols", _DIFF + " SELECT * FROM diff WHERE src LIKE 'T:cust.%' OR dst LIKE 'T:cust.%'")(lambda t: change.diff_scoped(change.diff_edges(*_edges_ab(t)), t.symbols.filter("assembly = 'crm'")))
query("match_transitions", "symbols", ", x AS (SELECT symbol_id, kind, assembly, fqn, coalesce(accessibility, '') || fqn AS fp FROM symbols) SELECT min(symbol_id) AS old, min(symbol_id) || 'n' AS new, 'rename_and_move' AS transition FROM x GROUP BY kind, assembly, fp HAVING count(*) = 1")(
    lambda t: change.match_transitions(*[t.symbols.select(i, "kind", "assembly", n, F.concat(F.coalesce("accessibility", F.lit("")), "fqn").alias("fingerprint")) for i, n in ((F.col("symbol_id"), F.col("fqn")), (F.concat("symbol_id", F.lit("n")).alias("symbol_id"), F.concat(F.lit("new."), "fqn", F.lit("n")).alias("fqn")))]))

# --- what-ifs and audits ----------------------------------------------------------------------------------------

_mem = lambda s, a="": f"(dst = '{s}' OR dst IN (SELECT dst FROM edges WHERE kind = 'Declares' AND src = '{s}'))"
query("simulate_rename", "edges", f"SELECT DISTINCT src AS affected, kind, doc, line FROM edges WHERE kind IN {ALIVE} AND {_mem(SUPP)}")(lambda t: change.simulate_rename(t.edges, SUPP))
query("simulate_move", "edges", f"SELECT DISTINCT src AS affected, kind, doc, line FROM edges WHERE kind IN {ALIVE} AND {_mem(NATION)}")(lambda t: change.simulate_move(t.edges, NATION))
query("simulate_remove", "edges", _reach(f"SELECT node AS affected, depth FROM r WHERE depth > 0 AND node NOT IN (SELECT dst FROM edges WHERE kind IN ('Registers', 'TestedBy', 'Implements') AND src = '{NATION}')", NATION, "dst", "src", 10))(lambda t: change.simulate_remove(t.raw_edges, NATION))
_USED = f"used AS (SELECT DISTINCT dst AS s FROM raw_edges WHERE kind IN {ALIVE})"
query("audit_dead", "raw_edges symbols", f", {_USED} SELECT symbol_id FROM symbols WHERE symbol_id NOT IN (SELECT s FROM used) AND symbol_id NOT IN (SELECT src FROM raw_edges WHERE kind = 'Declares' AND src LIKE 'T:%' AND dst IN (SELECT s FROM used))")(lambda t: change.audit_dead(t.raw_edges, t.symbols))
query("audit_untested", "raw_edges symbols", "SELECT symbol_id FROM symbols WHERE accessibility IN ('Public', 'Internal') AND symbol_id NOT IN (SELECT src FROM raw_edges WHERE kind = 'TestedBy') AND symbol_id NOT IN (SELECT dst FROM raw_edges WHERE kind = 'Declares' AND src IN (SELECT src FROM raw_edges WHERE kind = 'TestedBy'))")(lambda t: change.audit_untested(t.raw_edges, t.symbols))
query("audit_unregistered", "edges symbols", ", r AS MATERIALIZED (SELECT DISTINCT dst FROM edges WHERE kind = 'Registers') SELECT e.src, e.dst FROM edges e JOIN symbols s ON s.symbol_id = e.src LEFT JOIN r ON r.dst = e.src WHERE e.kind = 'Implements' AND s.type_kind = 'Class' AND NOT s.is_abstract AND r.dst IS NULL")(lambda t: change.audit_unregistered(t.links, t.symbols))

# --- freshness and upkeep ---------------------------------------------------------------------------------------


def _versions(t, changed: bool) -> DataFrame:
    d = t.docs.filter("doc_id % 9 <> 4") if changed else t.docs.filter("doc_id % 9 <> 5")
    c = F.when(F.col("doc_id") % 9 == 6, F.concat("content", F.lit("!"))).otherwise(F.col("content")) if changed else F.col("content")
    return d.select("path", F.sha2(c, 256).alias("content_hash"), "doc_id")


query("detect_changes", "docs", "SELECT path, CASE doc_id % 9 WHEN 4 THEN 'Deleted' WHEN 5 THEN 'New' WHEN 6 THEN 'Changed' ELSE 'Unchanged' END AS state FROM docs")(lambda t: change.detect_changes(_versions(t, False), _versions(t, True)))
for _mode, _hit in (("auto", "doc_id % 9 IN (6, 7)"), ("hash", "doc_id % 9 = 6")):
    query(f"freshness_cheap_{_mode}", "docs", f"SELECT path, CASE WHEN doc_id % 9 = 4 THEN 'missing' ELSE 'touched' END AS why FROM docs WHERE doc_id % 9 <> 5 AND (doc_id % 9 = 4 OR {_hit})")(
        lambda t, m=_mode: change.freshness_cheap(_versions(t, False).withColumn("built_at", F.lit("2024-01-02").cast("timestamp")), _versions(t, True).withColumn("mtime", F.when(F.col("doc_id") % 9 >= 6, F.lit("2024-01-03")).otherwise(F.lit("2024-01-01")).cast("timestamp")).filter("doc_id % 9 <> 8 OR true").withColumn("mtime", F.when(F.col("doc_id") % 9 == 8, F.lit("2024-01-01").cast("timestamp")).otherwise(F.col("mtime"))), m))
query("freshness_full", "docs", "SELECT 'sdk_mismatch' AS mismatch, NULL AS path UNION ALL SELECT CASE doc_id % 9 WHEN 4 THEN 'document_removed' WHEN 5 THEN 'document_added' ELSE 'document_changed' END, path FROM docs WHERE doc_id % 9 IN (4, 5, 6)")(
    lambda t: change.freshness_full({"sdk": "9", "workspace": "w"}, {"sdk": "10", "workspace": "w"}, _versions(t, False), _versions(t, True)))
query("delete_by_documents", "edges", f"SELECT {EDGE} FROM edges WHERE doc IS NULL OR doc NOT IN (SELECT DISTINCT doc FROM edges WHERE doc LIKE 'crm/1%')")(lambda t: change.retire(t.edges, t.raw_edges.filter("doc LIKE 'crm/1%'").select("doc").distinct(), "doc"))
query("delete_null_path_by_assembly", "edges", f"SELECT {EDGE} FROM edges WHERE NOT (doc IS NULL AND split_part(src, '|', 2) = 'inv')")(lambda t: change.retire_null_path(t.edges, ["inv"]))
query("delete_by_project", "diagnostics", "SELECT seq, project FROM diagnostics WHERE project NOT IN ('src1', 'src9')")(lambda t: change.retire(t.diagnostics.select("seq", "project"), t.spark.createDataFrame([("src1",), ("src9",)], "p string"), "project"))
@query("incremental_edges", "edges", f"SELECT {EDGE} FROM edges")
def _incremental(t: Tables) -> DataFrame:
    """The edges of a stored snapshot whose documents crm/2… were out of date, after these are derived anew: only edges that such a document has evidence of are deduplicated again."""
    scope = t.raw_edges.filter("doc LIKE 'crm/2%'").select("doc").distinct()
    stale = t.keyed_edges.withColumn("provenance", F.when(F.col("doc").like("crm/2%"), "possible").otherwise(F.col("provenance")))
    return change.refresh_deduplicated(stale, t.raw_edges, scope)


query("prune_removed_symbols", "symbols decls", "SELECT symbol_id FROM symbols WHERE symbol_id NOT IN (SELECT 'T:cust.' || CAST(conv_id AS VARCHAR) || '|crm' FROM decls)")(lambda t: change.prune_removed_symbols(t.symbols, t.turns.select(F.concat(F.lit("T:cust."), F.col("conv_id").cast("string"), F.lit("|crm")).alias("symbol_id"))))
_last = "SELECT user_id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type {}) x WHERE rn = 1"
query("last_wins_upsert", "", f"WITH old AS ({_last.format("<> 'purchase'")}), new AS ({_last.format("= 'purchase'")}) SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id)")(
    lambda t: (lambda e: change.last_wins(change.last_wins(e.filter("false").drop("event_type"), e.filter("event_type <> 'purchase'").drop("event_type"), ["user_id"]), e.filter("event_type = 'purchase'").drop("event_type"), ["user_id"]))(t.events.select("user_id", F.col("event_id").alias("seq"), "value", "event_type")))
query("first_wins_insert", "", "SELECT user_id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) x WHERE rn = 1")(lambda t: change.first_wins(t.events.select("user_id", F.col("event_id").alias("seq"), "value"), ["user_id"]))
query("upsert_extractors", "", "SELECT DISTINCT source AS name, CASE WHEN lang = 'de' THEN '2' ELSE '1' END AS version FROM documents WHERE lang = 'de' OR source NOT IN (SELECT source FROM documents WHERE lang = 'de')")(
    lambda t: change.upsert_extractors(t.documents.select(F.col("source").alias("name"), F.lit("1").alias("version")).distinct(), t.documents.filter("lang = 'de'").select(F.col("source").alias("name"), F.lit("2").alias("version"))))

# --- bundles ----------------------------------------------------------------------------------------------------

_id = lambda t, s: t.spark.createDataFrame([(s,)], "id string")
query("tier_contracts", "edges", f"SELECT 'contracts' AS tier, dst AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind IN ('Inherits', 'Implements', 'Overrides') AND src = '{CUST}' GROUP BY dst")(lambda t: capsule.tier_contracts(t.edges, _id(t, CUST)))
query("tier_direct_callees", "edges", f"SELECT 'directCallees' AS tier, dst AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind = 'Calls' AND src = '{ORDER}' GROUP BY dst")(lambda t: capsule.tier_direct_callees(t.edges, _id(t, ORDER)))
query("tier_direct_callers", "edges", f"SELECT 'directCallers' AS tier, src AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind = 'Calls' AND dst = '{PART}' GROUP BY src")(lambda t: capsule.tier_direct_callers(t.edges, _id(t, PART)))
query("tier_registered_impls", "edges", f"SELECT 'registeredImplementations' AS tier, CASE WHEN src = '{PART}' THEN dst ELSE src END AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind = 'Registers' AND (src = '{PART}' OR dst = '{PART}') GROUP BY 2")(lambda t: capsule.tier_registered_impls(t.edges, _id(t, PART)))
query("tier_relevant_tests", "edges", _reach("SELECT 'relevantTests' AS tier, dst AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind = 'TestedBy' AND src IN (SELECT node FROM r) GROUP BY dst", PART, "dst", "src", 3, "WHERE kind = 'Calls'"))(lambda t: capsule.tier_relevant_tests(t.edges, _id(t, PART)))
query("tier_second_degree", "edges", _reach("SELECT 'secondDegree' AS tier, node AS symbol_id, 'possible' AS provenance FROM r WHERE depth > 1", PART, "dst", "src", 3, "WHERE kind = 'Calls'"))(lambda t: capsule.tier_second_degree(t.edges, _id(t, PART)))
query("tier_surrounding", "edges", f"SELECT 'surroundingSource' AS tier, dst AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind = 'Declares' AND src = '{CUST}' GROUP BY dst")(lambda t: capsule.tier_surrounding(t.edges, _id(t, CUST)))
def _tiers(anchor: str) -> str:
    """CTE `t`: the tiers of a type, in the order for a type, with each symbol in the first one that has it."""
    own, kin = f"kind IN ('Declares', 'Contains')", "'Calls', 'Constructs'"
    parts = [
        ("contracts", f"SELECT dst AS symbol_id, min(provenance) AS provenance FROM edges WHERE kind IN ('Inherits', 'Implements', 'Overrides') AND src = '{anchor}' GROUP BY dst"),
        ("directCallees", f"SELECT dst, min(provenance) FROM (SELECT dst, provenance FROM edges WHERE kind IN ({kin}) AND src = '{anchor}' UNION ALL SELECT m.dst, 'global_implementation_relation' FROM edges m WHERE m.kind = 'MayDispatchTo' AND m.src IN (SELECT dst FROM edges WHERE kind IN ({kin}) AND src = '{anchor}') AND m.dst NOT IN (SELECT dst FROM edges WHERE kind IN ({kin}) AND src = '{anchor}')) x GROUP BY dst"),
        ("directCallers", f"SELECT src, min(provenance) FROM edges WHERE (kind = 'Calls' OR kind IN ('RoutesTo', 'Handles') AND src NOT IN (SELECT src FROM edges WHERE kind = 'Calls' AND dst = '{anchor}')) AND dst = '{anchor}' GROUP BY src"),
        ("registeredImplementations", f"SELECT CASE WHEN src = '{anchor}' THEN dst ELSE src END, min(provenance) FROM edges WHERE kind IN ('MayDispatchTo', 'Registers') AND (src = '{anchor}' OR dst = '{anchor}') OR kind = 'Handles' AND src = '{anchor}' GROUP BY 1"),
        ("surroundingSource", f"SELECT dst, min(provenance) FROM edges WHERE {own} AND dst <> '{anchor}' AND src IN (SELECT src FROM edges WHERE {own} AND dst = '{anchor}' UNION SELECT '{anchor}') GROUP BY dst"),
        ("secondDegree", "SELECT node, 'possible' FROM r WHERE depth > 1"),
        ("relevantTests", "SELECT dst, min(provenance) FROM edges WHERE kind = 'TestedBy' AND src IN (SELECT node FROM r) GROUP BY dst"),
    ]
    rows = " UNION ALL ".join(f"SELECT {i} AS tier_rank, '{n}' AS tier, * FROM ({q}) q{i}" for i, (n, q) in enumerate(parts))
    one = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY tier_rank) AS rn FROM every) z WHERE rn = 1"
    return _reach(f", every(tier_rank, tier, symbol_id, provenance) AS ({rows}), t AS (SELECT f.symbol_id, f.tier_rank, f.tier, f.provenance, s.fqn, CAST(row_number() OVER (PARTITION BY f.tier_rank ORDER BY f.symbol_id) AS INTEGER) AS item_rank FROM ({one}) f LEFT JOIN symbols s ON s.symbol_id = f.symbol_id)", anchor, "dst", "src", 3, "WHERE kind = 'Calls'")


def _budgeted(cost: str, budget: int) -> str:
    return f", c AS (SELECT *, CAST({cost} AS INTEGER) AS cost FROM t), b AS (SELECT *, CAST(sum(cost) OVER (ORDER BY tier_rank, item_rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c)"


query("context_capsule", "edges symbols", _tiers(PART) + _budgeted("floor(length(coalesce(fqn, symbol_id)) / 4)", 200) + " SELECT symbol_id, tier_rank, tier, provenance, fqn, item_rank, cost, running, running <= 200 AS included FROM b")(
    lambda t: capsule.budget_prefix(capsule.all_tiers(t.edges, t.symbols, PART).withColumn("cost", fx.token_estimate(F.coalesce("fqn", "symbol_id"))), 200))
query("tier_page", "edges symbols", _tiers(PART) + " SELECT symbol_id, tier_rank, tier, provenance, fqn, item_rank FROM t WHERE tier = 'directCallers' AND item_rank BETWEEN 1 AND 5")(lambda t: capsule.tier_page(capsule.all_tiers(t.edges, t.symbols, PART), "directCallers", 0, 5))
_order = ", ".join(f"('{n}')" for n in capsule.tier_order(True))
query("tier_reasons", "edges symbols", _tiers(PART) + _budgeted("5", 100) + f" SELECT o.tier, count(*) FILTER (WHERE running <= 100) AS included, CASE WHEN count(b.tier) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE running <= 100) < count(b.tier) THEN 'budget_exhausted' END AS reason FROM (VALUES {_order}) o(tier) LEFT JOIN b ON b.tier = o.tier GROUP BY o.tier")(
    lambda t: capsule.tier_reasons(capsule.budget_prefix(capsule.all_tiers(t.edges, t.symbols, PART).withColumn("cost", F.lit(5)), 100), capsule.tier_order(True)))
query("budget_prefix", "docs", "SELECT path, CAST(running AS BIGINT) AS running, running <= 100000 AS included FROM (SELECT path, sum(floor(len(content) / 4)) OVER (ORDER BY project, path ROWS UNBOUNDED PRECEDING) AS running FROM docs) x")(
    lambda t: capsule.budget_prefix(t.docs.select(F.col("project").alias("tier_rank"), F.col("path").alias("item_rank"), "path", fx.token_estimate("content").alias("cost")), 100000).select("path", F.col("running").cast("bigint").alias("running"), "included"))
query("compose_provenance", "raw_edges", "SELECT src, dst, CASE WHEN bool_or(provenance = 'framework_derived') THEN 'framework_derived' ELSE 'possible' END AS provenance FROM raw_edges GROUP BY src, dst")(
    lambda t: t.raw_edges.groupBy("src", "dst").agg(F.collect_set("provenance").alias("p")).select("src", "dst", capsule.compose_provenance("p").alias("provenance")))
query("uncertainties", "edges incompleteness", f", o AS (SELECT * FROM edges WHERE src = '{ORDER}') SELECT * FROM (SELECT 'missing_receiver' AS rule, count(*) AS n FROM o WHERE kind = 'Calls' AND type_args IS NULL UNION ALL SELECT 'convention', count(*) FROM o WHERE provenance = 'convention' UNION ALL SELECT 'possible', count(*) FROM o WHERE provenance = 'possible' UNION ALL SELECT 'cross_generated', count(*) FROM o WHERE cross_generated UNION ALL SELECT 'incompleteness', CAST(sum(occurrences) AS BIGINT) FROM incompleteness) x WHERE n > 0")(
    lambda t: capsule.uncertainties(t.edges, t.incompleteness, _id(t, ORDER)))
query("suggested_verification", "edges", f"SELECT DISTINCT 'test ' || dst AS command FROM edges WHERE kind = 'TestedBy' AND src = '{PART}'")(lambda t: capsule.suggested_verification(t.edges, _id(t, PART)))
query("constraint_annotations", "annotations", "SELECT symbol_id, kind, value FROM annotations WHERE kind LIKE '%constraint%' OR kind LIKE '%invariant%'")(lambda t: t.annotations.filter("kind LIKE '%constraint%' OR kind LIKE '%invariant%'").select("symbol_id", "kind", "value"))

query("keyset_page_fts", "docs", _post + _bm25("'the'", 1).replace("SELECT key AS path, round(rank, 6) AS rank FROM r WHERE hits >= 1", ", k AS (SELECT key, round(rank, 6) AS rank FROM r) SELECT key, rank FROM k WHERE rank > -0.5 OR (rank = -0.5 AND key > '') ORDER BY rank, key LIMIT 11"))(
    lambda t: search.keyset_page(search.bm25(*search.build_search_index(t.docs, "path", ["content"]), "the").withColumn("rank", F.round("rank", 6)), "rank", "key", (-0.5, ""), 10))
query("extractor_registry", "", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, v in adapters.EXTRACTORS) + ") x(name, version)")(lambda t: adapters.extractor_registry(t.spark))
query("declared_boundaries", "", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(c, n.replace("'", "''")) for c, n in adapters.BOUNDARIES) + ") x(construct, note)")(lambda t: adapters.declared_boundaries(t.spark))
query("change_feed_windows", "", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda t: feed.counts_by_window(t.events))
query("sink_json", "symbols", """SELECT '{"symbol_id":"' || symbol_id || '"}' AS value FROM symbols""")(lambda t: sinks.to_json(t.symbols.select("symbol_id")))
query("sink_summary", "symbols", "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")(lambda t: sinks.summary(t.symbols, "kind"))
query("expand_partial_parts", "raw_edges", ", d AS (SELECT DISTINCT dst AS symbol_id, doc AS path FROM raw_edges WHERE kind = 'Reads') SELECT DISTINCT path FROM d WHERE symbol_id IN (SELECT symbol_id FROM d WHERE path = 'sales/1.cs')")(
    lambda t: graph.expand_partial_parts(t.raw_edges.filter("kind = 'Reads'").select(F.col("dst").alias("symbol_id"), F.col("doc").alias("path")).distinct(), t.spark.createDataFrame([("sales/1.cs",)], "path string")))
query("anchor_region_lost", "docs incompleteness", "SELECT DISTINCT path FROM docs WHERE path IN (SELECT document_path FROM incompleteness WHERE reason IN ('error', 'signup'))")(lambda t: capsule.anchor_region_lost(t.incompleteness, t.docs, ["error", "signup"]))
query("change_sites", "edges", f"SELECT doc, CAST(min(r) AS INTEGER) AS rank FROM (SELECT doc, 0 AS r FROM edges WHERE src = '{PART}' UNION ALL SELECT doc, 1 FROM edges WHERE dst = '{PART}' AND kind IN ('Calls', 'Constructs', 'Reads') UNION ALL SELECT doc, 2 FROM edges WHERE dst = '{PART}' AND kind IN ('Implements', 'Overrides', 'Registers', 'Inherits')) x WHERE doc IS NOT NULL GROUP BY doc")(lambda t: capsule.change_sites(t.edges, _id(t, PART)))
