"""Queries of the extraction rules and framework adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import extract, retrieval
from .queries import query


def _sql(kind: str, src: str, dst: str, table: str, where: str = "true", provenance: str = "'compiler_proved'") -> str:
    return f"SELECT DISTINCT {src} AS src, {dst} AS dst, '{kind}' AS kind, {provenance} AS provenance FROM {table} WHERE {where}"


M, I, S, T = "raw_member", "raw_invocation", "raw_site", "raw_type"
query("edge_declares", M, _sql("Declares", "type", "member", M, "NOT is_nested AND NOT is_implicit"))(lambda t: extract.declares(t.raw_member))
query("edge_contains", M, _sql("Contains", "type", "member", M, "is_nested"))(lambda t: extract.contains(t.raw_member))
query("edge_calls", I, f"SELECT caller AS src, callee AS dst, 'Calls' AS kind, 'compiler_proved' AS provenance, string_agg(DISTINCT receiver, ',' ORDER BY receiver) AS receivers FROM {I} WHERE caller <> callee AND NOT is_lambda GROUP BY caller, callee")(lambda t: extract.calls(t.raw_invocation))
query("receiver_constraints", I, f"SELECT callee, string_agg(DISTINCT receiver, ',' ORDER BY receiver) AS receivers FROM {I} GROUP BY callee")(lambda t: t.raw_invocation.groupBy("callee").agg(F.array_join(F.array_sort(F.collect_set("receiver")), ",").alias("receivers")))
query("edge_references_static", I, _sql("References", "caller", "receiver", I, "is_static"))(lambda t: extract.static_receiver(t.raw_invocation))
query("edge_extension_receiver", I, _sql("ExtensionReceiver", "receiver", "callee", I, "is_reduced"))(lambda t: extract.extension_receiver(t.raw_invocation))
query("edge_reads_writes", I, _sql("Reads", "caller", "receiver", I, "NOT is_write") + " UNION ALL " + _sql("Writes", "caller", "receiver", I, "is_write"))(lambda t: extract.accesses(t.raw_invocation.withColumn("member", F.col("receiver"))))
query("edge_constructs", S, _sql("Constructs", "caller", "target", S, "form = 'signup'"))(lambda t: extract.constructs(t.raw_site.filter("form = 'signup'").withColumn("type", F.col("target"))))
query("edge_overrides", M, _sql("Overrides", "member", "overridden", M, "overridden IS NOT NULL"))(lambda t: extract.overrides(t.raw_member))
query("edge_hides", f"{M} {T}", f"SELECT DISTINCT m.member AS src, h.member AS dst, 'Hides' AS kind, 'compiler_proved' AS provenance FROM {M} m JOIN {M} h ON h.type = 'T:cust.' || CAST(CAST(split_part(split_part(m.type, '|', 1), '.', 2) AS BIGINT) - 1 AS VARCHAR) || '|crm' AND h.name = m.name AND h.params = m.params WHERE m.overridden IS NULL AND h.accessibility <> 'Private'")(
    lambda t: extract.hides(t.raw_member, t.customer.select(F.concat(F.lit("T:cust."), F.col("c_custkey").cast("string"), F.lit("|crm")).alias("type"), F.concat(F.lit("T:cust."), (F.col("c_custkey") - 1).cast("string"), F.lit("|crm")).alias("base"))))
query("edge_returns", M, _sql("Returns", "member", "return_type", M, "return_type <> 'void'"))(lambda t: extract.returns(t.raw_member))
query("edge_references_params", M, f"SELECT DISTINCT * FROM ({_sql('References', 'member', 'parameter1', M)} UNION ALL {_sql('References', 'member', 'parameter2', M)}) x")(lambda t: extract.parameter_types(t.raw_member.withColumn("parameter_types", F.array("parameter1", "parameter2"))))
query("edge_throws", S, _sql("Throws", "caller", "target", S, "form = 'error'"))(lambda t: extract.throws(t.raw_site.filter("form = 'error'").withColumn("type", F.col("target"))))
query("edge_inherits", T, _sql("Inherits", "type", "base", T, "base NOT IN ('T:System.Object', 'T:System.ValueType')"))(lambda t: extract.inherits(t.raw_type))
query("edge_implements", T, f"SELECT DISTINCT * FROM ({_sql('Implements', 'type', 'interface1', T)} UNION ALL {_sql('Implements', 'type', 'interface2', T)}) x")(lambda t: extract.implements(t.raw_type.withColumn("interfaces", F.array("interface1", "interface2"))))
query("edge_references_members", M, _sql("References", "type", "member_type", M, "NOT is_implicit AND member_type <> type"))(lambda t: extract.member_types(t.raw_member))
query("edge_may_dispatch_iface", M, _sql("MayDispatchTo", "parameter1", "member", M, "true", "CASE WHEN is_nested THEN 'possible' ELSE 'compiler_proved' END"))(
    lambda t: extract.interface_dispatch(t.raw_member.select("type", F.col("parameter1").alias("interface_member"), F.col("member").alias("implementation"), F.when(F.col("is_nested"), "other").otherwise(F.col("type")).alias("declared_on"))))
query("edge_may_dispatch_virtual", M, f", r AS (SELECT member, overridden AS root FROM {M} WHERE overridden IS NOT NULL UNION ALL SELECT r.member, m.overridden FROM r JOIN {M} m ON m.member = r.root WHERE m.overridden IS NOT NULL) SELECT DISTINCT root AS src, r.member AS dst, 'MayDispatchTo' AS kind, 'possible' AS provenance FROM r LEFT JOIN {M} m ON m.member = r.root WHERE m.overridden IS NULL")(lambda t: extract.virtual_dispatch(t.raw_member))
query("edge_statically_calls", I, _sql("StaticallyCalls", "caller", "callee", I, "callee_is_virtual"))(lambda t: extract.static_dispatch(t.raw_invocation))
query("edge_reflection", S, _sql("ReflectionType", "caller", "target", S, "form = 'view'") + " UNION ALL " + _sql("ReflectionMember", "caller", "target", S, "form = 'click'") + " UNION ALL " + _sql("ReflectionUnknown", "caller", "caller", S, "form = 'error'", "'runtime_unknown'"))(
    lambda t: extract.reflection(t.raw_site.withColumn("form", F.expr("CASE form WHEN 'view' THEN 'typeof' WHEN 'click' THEN 'nameof' WHEN 'error' THEN 'unknown' END"))))
query("edge_reflection_name", f"{S} symbols", f", n AS (SELECT lower(list_extract(string_split(fqn, '.'), -1)) AS n, min((CASE WHEN symbol_id LIKE 'T:%' THEN '0' ELSE '1' END) || symbol_id) AS s FROM symbols GROUP BY 1) SELECT DISTINCT caller AS src, substr(s, 2) AS dst, 'ReflectionName' AS kind, 'name_candidate' AS provenance FROM {S} JOIN n ON lower('Customer#' || lpad(literal, 9, '0')) = n")(
    lambda t: extract.reflection_name(t.raw_site.withColumn("value", F.concat(F.lit("Customer#"), F.lpad("literal", 9, "0"))), t.symbols))
query("adp_aspnet", M, _sql("RoutesTo", "CASE WHEN is_nested THEN 'route:' || name ELSE 'route:api/' || params || '/' || name END", "member", M, "true", "'framework_derived'"))(
    lambda t: extract.aspnet_routes(t.raw_member.select("member", F.concat(F.lit("api/"), "params").alias("class_route"), F.when(F.col("is_nested"), F.concat(F.lit("/"), "name")).otherwise(F.col("name")).alias("method_route"))))
_reg = "form IN ('view', 'click')"
query("adp_di", S, f"SELECT DISTINCT * FROM ({_sql('Registers', 'caller', 'target', S, _reg, chr(39) + 'framework_derived' + chr(39))} UNION ALL {_sql('Registers', 'literal', 'target', S, _reg, chr(39) + 'framework_derived' + chr(39))}) x UNION ALL {_sql('Registers', 'caller', chr(39) + 'runtime:unknown' + chr(39), S, 'form = ' + chr(39) + 'error' + chr(39), chr(39) + 'runtime_unknown' + chr(39))} UNION ALL {_sql('Registers', 'caller', chr(39) + 'convention:' + chr(39) + ' || caller', S, 'form = ' + chr(39) + 'signup' + chr(39), chr(39) + 'convention' + chr(39))}")(
    lambda t: extract.di_registrations(t.raw_site.select(F.col("caller").alias("registrar"), F.col("literal").alias("service"), F.when(F.col("form") != "error", F.col("target")).alias("implementation"), F.expr("CASE form WHEN 'error' THEN 'hosted' WHEN 'signup' THEN 'scan' WHEN 'purchase' THEN 'none' ELSE 'explicit' END").alias("form"))))
query("adp_di_scan", T, f"SELECT DISTINCT * FROM ({_sql('Registers', 'interface1', 'type', T, 'NOT is_abstract AND assembly IN (' + chr(39) + 'a1' + chr(39) + ')', chr(39) + 'convention' + chr(39))} UNION ALL {_sql('Registers', 'interface2', 'type', T, 'NOT is_abstract AND assembly IN (' + chr(39) + 'a1' + chr(39) + ')', chr(39) + 'convention' + chr(39))}) x")(
    lambda t: extract.di_scan(t.spark.createDataFrame([("a1",)], "assembly string"), t.raw_type.withColumn("interfaces", F.array("interface1", "interface2"))))
query("adp_mediatr", M, _sql("Handles", "parameter1", "member", M, "params IN ('F', 'O')", "'framework_derived'"))(
    lambda t: extract.mediatr_handles(t.raw_member.select(F.expr("CASE params WHEN 'F' THEN 'IRequestHandler' WHEN 'O' THEN 'INotificationHandler' END").alias("interface"), F.col("parameter1").alias("request"), F.col("member").alias("handle"))))
query("adp_efcore", T, _sql("MapsTo", "interface1", "type", T, "true", "'framework_derived'"))(lambda t: extract.efcore_maps(t.raw_type.select(F.col("interface1").alias("context"), F.col("type").alias("entity"))))
query("adp_serialization", M, _sql("References", "type", "member", M, "params IN ('F', 'P')", "'framework_derived'"))(
    lambda t: extract.serialization_members(t.raw_member.select(F.expr("CASE params WHEN 'F' THEN 'JsonPropertyName' WHEN 'P' THEN 'DataMember' ELSE 'Obsolete' END").alias("attribute"), F.col("type").alias("owner"), F.col("member").alias("target"))))
query("adp_test", I, _sql("TestedBy", "callee", "caller", I, "is_static", "'framework_derived'"))(
    lambda t: extract.tested_by(t.raw_invocation.select(F.col("caller").alias("test"), F.when(F.col("is_static"), "tests").otherwise("inv").alias("test_assembly"), F.col("callee").alias("type"), F.lit("inv").alias("assembly"))))
query("incompleteness_collect", S, f"SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS project, caller AS document_path, form AS reason, count(*) AS occurrences FROM {S} GROUP BY ALL")(
    lambda t: extract.incompleteness_collect(t.raw_site.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"), F.col("caller").alias("document_path"), F.col("form").alias("reason"))))
query("location_resolve", "docs", ", k AS (SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 3 THEN '.g.cs' ELSE '.txt' END AS wanted, path FROM docs) SELECT wanted, min(path) AS path FROM k GROUP BY wanted HAVING count(*) = 1")(
    lambda t: extract.location_resolve(t.docs.select(F.substring_index("path", "/", -1).alias("wanted")).distinct(), t.docs.select("path")))
query("ext_declarations", "decls", "SELECT symbol_id, path, full_start, full_end, count(*) OVER (PARTITION BY symbol_id) > 1 AS is_partial FROM decls")(
    lambda t: t.decls.join(t.decls.groupBy("symbol_id").agg((F.count(F.lit(1)) > 1).alias("is_partial")), "symbol_id").select("symbol_id", "path", "full_start", "full_end", "is_partial"))
query("ext_spans", "decls", "SELECT symbol_id, substr(text, 1, 1) AS head, full_end - full_start AS bytes FROM decls WHERE full_end > full_start")(
    lambda t: t.decls.filter("full_end > full_start").join(t.conv_docs.select("path", "content"), "path").select("symbol_id", F.substring(fx.slice_bytes(F.encode("content", "UTF-8"), "full_start", "full_end"), 1, 1).alias("head"), (F.col("full_end") - F.col("full_start")).alias("bytes")))
query("ext_metadata", "symbols", """SELECT symbol_id, '{"accessibility":"' || accessibility || '","isAbstract":' || CASE WHEN is_abstract THEN 'true' ELSE 'false' END || CASE WHEN type_kind IS NOT NULL THEN ',"typeKind":"' || type_kind || '"' ELSE '' END || '}' AS metadata FROM symbols""")(
    lambda t: t.symbols.select("symbol_id", F.to_json(F.struct("accessibility", F.col("is_abstract").alias("isAbstract"), F.col("type_kind").alias("typeKind"))).alias("metadata")))
query("symbol_id_make", "symbols", "SELECT symbol_id, doc_comment_id || '|' || assembly AS made FROM symbols")(lambda t: t.symbols.select("symbol_id", F.concat_ws("|", "doc_comment_id", "assembly").alias("made")))
query("symbols_in_documents", "decls", "SELECT DISTINCT symbol_id FROM decls WHERE conv_id % 2 = 0")(
    lambda t: retrieval.documents_of(t.decls, t.decls.filter("conv_id % 2 = 0").select("path").distinct()).select("symbol_id").distinct())
