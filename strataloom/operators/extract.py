"""From bound syntax facts (staging tables) to edges (src, dst, kind, provenance)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise


def _edges(df: DataFrame, src: str | Column, dst: str | Column, kind: str, provenance: str | Column = "compiler_proved") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    prov = F.lit(provenance) if isinstance(provenance, str) else provenance
    return df.select(col(src).alias("src"), col(dst).alias("dst"), F.lit(kind).alias("kind"), prov.alias("provenance")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def declares(members: DataFrame) -> DataFrame:
    """members (type, member, is_nested, is_implicit)."""
    return _edges(members.filter("NOT is_nested AND NOT is_implicit"), "type", "member", "Declares")


def contains(members: DataFrame) -> DataFrame:
    return _edges(members.filter("is_nested"), "type", "member", "Contains")


def calls(invocations: DataFrame) -> DataFrame:
    """invocations (caller, callee, is_lambda, receiver): a method's calls of others; the receivers of all sites are united, sorted."""
    ok = invocations.filter("caller <> callee AND NOT is_lambda")
    return ok.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("receiver")), ",").alias("receivers")).select("src", "dst", F.lit("Calls").alias("kind"), F.lit("compiler_proved").alias("provenance"), "receivers")


def static_receiver(invocations: DataFrame) -> DataFrame:
    return _edges(invocations.filter("is_static"), "caller", "receiver", "References")


def extension_receiver(invocations: DataFrame) -> DataFrame:
    return _edges(invocations.filter("is_reduced"), "receiver", "callee", "ExtensionReceiver")


def accesses(access: DataFrame) -> DataFrame:
    """access (caller, member, is_write): Reads and Writes."""
    return _edges(access.filter("NOT is_write"), "caller", "member", "Reads").unionByName(_edges(access.filter("is_write"), "caller", "member", "Writes"))


def constructs(creations: DataFrame) -> DataFrame:
    return _edges(creations, "caller", "type", "Constructs")


def overrides(members: DataFrame) -> DataFrame:
    return _edges(members, "member", "overridden", "Overrides")


def hides(members: DataFrame, bases: DataFrame) -> DataFrame:
    """members (type, member, name, params, overridden, accessibility); bases (type, base): same name and parameters in the immediate base."""
    b = members.filter("accessibility <> 'Private'").select(F.col("type").alias("base"), F.col("member").alias("hidden"), "name", "params")
    return _edges(members.filter("overridden IS NULL").join(bases, "type").join(b, ["base", "name", "params"]), "member", "hidden", "Hides")


def returns(members: DataFrame) -> DataFrame:
    return _edges(members.filter("return_type <> 'void'"), "member", "return_type", "Returns")


def parameter_types(members: DataFrame) -> DataFrame:
    return _edges(members.select("member", F.explode("parameter_types").alias("t")), "member", "t", "References")


def throws(sites: DataFrame) -> DataFrame:
    return _edges(sites, "caller", "type", "Throws")


def inherits(types: DataFrame) -> DataFrame:
    return _edges(types.filter("base NOT IN ('T:System.Object', 'T:System.ValueType')"), "type", "base", "Inherits")


def implements(types: DataFrame) -> DataFrame:
    return _edges(types.select("type", F.explode("interfaces").alias("i")), "type", "i", "Implements")


def member_types(members: DataFrame) -> DataFrame:
    return _edges(members.filter("NOT is_implicit AND member_type <> type"), "type", "member_type", "References")


def interface_dispatch(impls: DataFrame) -> DataFrame:
    """impls (type, interface_member, implementation, declared_on): proved where the type itself declares the implementation."""
    return _edges(impls, "interface_member", "implementation", "MayDispatchTo", F.when(F.col("declared_on") == F.col("type"), "compiler_proved").otherwise("possible"))


def virtual_dispatch(members: DataFrame) -> DataFrame:
    """From the root of each override chain to each override of it.

    Pointers are doubled until none moves: rounds grow with the logarithm of the longest chain.
    """
    at = materialise(members.filter("overridden IS NOT NULL").select("member", F.col("overridden").alias("root")).distinct())
    while True:
        step = at.select(F.col("member").alias("root"), F.col("root").alias("next"))
        j = materialise(at.join(step, "root", "left").select("member", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = j.select("member", "root")
        if j.filter("moved").isEmpty():
            return _edges(at, "root", "member", "MayDispatchTo", "possible")


def static_dispatch(invocations: DataFrame) -> DataFrame:
    return _edges(invocations.filter("callee_is_virtual"), "caller", "callee", "StaticallyCalls")


def reflection(sites: DataFrame) -> DataFrame:
    """sites (caller, form, target): typeof, nameof, and the calls whose target can't be known, which point to themselves."""
    form = F.col("form")
    return _edges(sites.filter(form == "typeof"), "caller", "target", "ReflectionType").unionByName(_edges(sites.filter(form == "nameof"), "caller", "target", "ReflectionMember")).unionByName(_edges(sites.filter(form == "unknown"), "caller", "caller", "ReflectionUnknown", "runtime_unknown"))


def reflection_name(literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """String literals (caller, value) of three characters or more, not digits, that are a symbol's simple name, case aside; the least id of several."""
    names = symbols.select(F.lower(F.substring_index("fqn", ".", -1)).alias("n"), "symbol_id", F.when(F.col("symbol_id").startswith("T:"), 0).otherwise(1).alias("o")).groupBy("n").agg(F.min(F.struct("o", "symbol_id")).alias("s"))
    ok = literals.filter((F.length("value") >= 3) & ~F.col("value").rlike("^[0-9]+$"))
    return _edges(ok.join(names, F.lower("value") == F.col("n")), "caller", "s.symbol_id", "ReflectionName", "name_candidate")


def incompleteness_collect(unbound: DataFrame) -> DataFrame:
    return unbound.groupBy("project", "document_path", "reason").agg(F.count(F.lit(1)).alias("occurrences"))


def location_resolve(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(wanted, path): the one known path that ends in the wanted suffix; nothing where several do."""
    parts = F.split("path", "/")
    tails = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    return wanted.join(tails, F.col("wanted") == F.col("tail")).groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


# --- framework adapters -----------------------------------------------------------------------------------------


def aspnet_routes(actions: DataFrame) -> DataFrame:
    """actions (type, member, class_route, method_route): a route node to its action; a method's leading slash overrides the class."""
    m, c = F.col("method_route"), F.col("class_route")
    route = F.when(m.startswith("/"), F.substring(m, 2, 10_000)).otherwise(F.concat_ws("/", F.nullif(c, F.lit("")), F.nullif(m, F.lit(""))))
    return _edges(actions, F.concat(F.lit("route:"), route), "member", "RoutesTo", "framework_derived")


def di_registrations(registrations: DataFrame) -> DataFrame:
    """registrations (registrar, service, implementation, form). explicit: the registrar and, unless it is the same, the service register the implementation;
    hosted: also runtime:unknown; scan: the placeholder of the convention."""
    r = registrations
    ex = r.filter("form = 'explicit'")
    out = [_edges(ex, "registrar", "implementation", "Registers", "framework_derived"), _edges(ex.filter("service <> implementation"), "service", "implementation", "Registers", "framework_derived")]
    ho = r.filter("form = 'hosted'")
    out += [_edges(ho, "registrar", F.lit("runtime:unknown"), "Registers", "runtime_unknown"), _edges(ho, "registrar", "implementation", "Registers", "framework_derived")]
    out += [_edges(r.filter("form = 'scan'"), "registrar", F.concat(F.lit("convention:"), "registrar"), "Registers", "convention")]
    return reduce(DataFrame.unionByName, out)


def di_scan(scans: DataFrame, types: DataFrame) -> DataFrame:
    """Interfaces to the concrete types (type, assembly, is_abstract, interfaces) of the scanned assembly (assembly)."""
    t = types.filter("NOT is_abstract").select("type", "assembly", F.explode("interfaces").alias("i"))
    return _edges(t.join(scans.select("assembly").distinct(), "assembly", "left_semi"), "i", "type", "Registers", "convention")


def mediatr_handles(handlers: DataFrame) -> DataFrame:
    return _edges(handlers.filter("interface IN ('IRequestHandler', 'INotificationHandler')"), "request", "handle", "Handles", "framework_derived")


def efcore_maps(sets: DataFrame) -> DataFrame:
    return _edges(sets, "context", "entity", "MapsTo", "framework_derived")


def serialization_members(attributes: DataFrame) -> DataFrame:
    names = ["JsonPropertyName", "JsonProperty", "DataMember", "JsonIgnore", "IgnoreDataMember", "JsonSerializable"]
    return _edges(attributes.filter(F.col("attribute").isin(names)), "owner", "target", "References", "framework_derived")


def tested_by(references: DataFrame) -> DataFrame:
    """references (test, test_assembly, type, assembly): across assemblies only."""
    return _edges(references.filter("test_assembly <> assembly"), "type", "test", "TestedBy", "framework_derived")
