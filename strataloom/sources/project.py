"""The given tables seen as a versioned semantic graph.

Each projection is one statement in the dialect that Spark and other SQL engines share; ``{table}`` stands for a given
table or another projection. Nodes are regions, nations, customers, suppliers, parts (types) and orders
(methods); edges come from the foreign keys and lineitem.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PROVENANCE = ["unknown", "runtime_unknown", "name_candidate", "convention", "possible", "global_implementation_relation", "framework_derived", "compiler_proved"]
_RANK = "CASE provenance " + " ".join(f"WHEN '{p}' THEN {i - 1}" for i, p in enumerate(PROVENANCE)) + " ELSE -1 END"
_ACCESS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Public' WHEN 'AUTOMOBILE' THEN 'Internal' WHEN 'MACHINERY' THEN 'Private' WHEN 'HOUSEHOLD' THEN 'Protected' ELSE 'ProtectedOrInternal' END"
_PROV = "CASE WHEN l_returnflag = 'A' THEN 'compiler_proved' WHEN l_returnflag = 'R' THEN 'framework_derived' WHEN l_linestatus = 'O' THEN 'possible' ELSE 'convention' END"
_ORDER, _PART, _SUPP = "'M:order.' || CAST(l_orderkey AS STRING) || '|sales'", "'T:part.' || CAST(l_partkey AS STRING) || '|inv'", "'T:supp.' || CAST(l_suppkey AS STRING) || '|inv'"
_LINE = f"{_PROV} AS provenance, 'sales/' || CAST(l_orderkey % 97 AS STRING) || '.cs' AS doc, l_linenumber AS line, l_linestatus = 'F' AS cross_generated"

PROJECTIONS = {
    "symbols": f"""
SELECT 'T:region.' || CAST(r_regionkey AS STRING) || '|geo' AS symbol_id, 'T:region.' || CAST(r_regionkey AS STRING) AS doc_comment_id, 'geo' AS assembly, 'NamedType' AS kind, 'geo.' || r_name AS fqn, 'Public' AS accessibility, true AS is_abstract, 'Interface' AS type_kind FROM {{region}}
UNION ALL SELECT 'T:nation.' || CAST(n_nationkey AS STRING) || '|geo', 'T:nation.' || CAST(n_nationkey AS STRING), 'geo', 'NamedType', 'geo.' || n_name, 'Public', false, 'Interface' FROM {{nation}}
UNION ALL SELECT 'T:cust.' || CAST(c_custkey AS STRING) || '|crm', 'T:cust.' || CAST(c_custkey AS STRING), 'crm', 'NamedType', 'crm.' || c_mktsegment || '.' || c_name, {_ACCESS}, c_acctbal < 0, 'Class' FROM {{customer}}
UNION ALL SELECT 'T:part.' || CAST(p_partkey AS STRING) || '|inv', 'T:part.' || CAST(p_partkey AS STRING), 'inv', 'NamedType', 'inv.' || p_brand || '.' || CAST(p_partkey AS STRING), 'Public', p_size > 45, 'Class' FROM {{part}}
UNION ALL SELECT 'T:supp.' || CAST(s_suppkey AS STRING) || '|inv', 'T:supp.' || CAST(s_suppkey AS STRING), 'inv', 'NamedType', 'inv.' || s_name, 'Internal', false, 'Class' FROM {{supplier}}
UNION ALL SELECT 'M:order.' || CAST(o_orderkey AS STRING) || '|sales', 'M:order.' || CAST(o_orderkey AS STRING), 'sales', 'Method', 'sales.' || o_orderpriority || '.' || CAST(o_orderkey AS STRING), CASE WHEN o_orderstatus = 'F' THEN 'Public' WHEN o_orderstatus = 'O' THEN 'Internal' ELSE 'Private' END, false, NULL FROM {{orders}}""",
    "raw_edges": f"""
SELECT 'T:nation.' || CAST(n_nationkey AS STRING) || '|geo' AS src, 'T:region.' || CAST(n_regionkey AS STRING) || '|geo' AS dst, 'Inherits' AS kind, 'compiler_proved' AS provenance, 'geo/nation.cs' AS doc, n_nationkey AS line, false AS cross_generated, CAST(NULL AS STRING) AS type_arg FROM {{nation}}
UNION ALL SELECT 'T:cust.' || CAST(c_custkey AS STRING) || '|crm', 'T:nation.' || CAST(c_nationkey AS STRING) || '|geo', 'Implements', 'compiler_proved', 'crm/' || CAST(c_custkey % 50 AS STRING) || '.cs', CAST(c_custkey % 1000 AS INT), false, c_mktsegment FROM {{customer}}
UNION ALL SELECT 'T:supp.' || CAST(s_suppkey AS STRING) || '|inv', 'T:nation.' || CAST(s_nationkey AS STRING) || '|geo', 'Implements', 'compiler_proved', CAST(NULL AS STRING), CAST(NULL AS INT), false, CAST(NULL AS STRING) FROM {{supplier}}
UNION ALL SELECT 'T:cust.' || CAST(o_custkey AS STRING) || '|crm', 'M:order.' || CAST(o_orderkey AS STRING) || '|sales', 'Declares', 'compiler_proved', 'crm/' || CAST(o_custkey % 50 AS STRING) || '.cs', CAST(o_orderkey % 1000 AS INT), false, CAST(NULL AS STRING) FROM {{orders}}
UNION ALL SELECT {_ORDER}, {_PART}, 'Calls', {_LINE}, l_linestatus FROM {{lineitem}}
UNION ALL SELECT {_ORDER}, {_SUPP}, 'Reads', {_LINE}, CAST(NULL AS STRING) FROM {{lineitem}}
UNION ALL SELECT {_PART}, {_SUPP}, 'Registers', {_LINE}, CAST(NULL AS STRING) FROM {{lineitem}} WHERE l_returnflag = 'A'
UNION ALL SELECT {_PART}, {_ORDER}, 'TestedBy', {_LINE}, CAST(NULL AS STRING) FROM {{lineitem}} WHERE l_linenumber = 1""",
    "docs": """
SELECT lang || '/' || source || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 11 = 3 THEN '.g.cs' ELSE '.txt' END AS path, source AS project, lang AS assembly, text AS content, doc_id FROM {documents}""",
    "snapshots": """
SELECT 's' || CAST(event_id AS STRING) AS snapshot_id, 'w' || CAST(user_id % 7 AS STRING) AS workspace_id, ts AS built_at,
CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'in_progress' ELSE 'complete' END AS status, CASE WHEN event_type = 'error' THEN 'reason_' || CAST(event_id % 3 AS STRING) END AS failure_reason FROM {events}""",
    "diagnostics": """
SELECT event_id AS seq, 'src' || CAST(user_id % 20 AS STRING) AS project, CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Info' ELSE 'Warning' END AS severity, 'CS' || CAST(event_id % 100 AS STRING) AS id, CAST(event_id % 500 AS INT) AS line, props AS message FROM {events}""",
    "incompleteness": """
SELECT project, document_path, reason, CAST(count(*) AS BIGINT) AS occurrences FROM (
SELECT 'src' || CAST(user_id % 20 AS STRING) AS project, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'en/src' || CAST(user_id % 20 AS STRING) || '/' || CAST(user_id AS STRING) || '.txt' END AS document_path, event_type AS reason FROM {events}) e GROUP BY project, document_path, reason""",
    "annotations": """
SELECT doc_id AS seq, 'T:cust.' || CAST(doc_id AS STRING) || '|crm' AS symbol_id, CASE WHEN toxic = 1 THEN 'constraint' WHEN quality = 1 THEN 'note' ELSE 'invariant:review' END AS kind, 'q' || CAST(quality AS STRING) AS value, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'crm/' || CAST(doc_id % 50 AS STRING) || '.cs' END AS document_path FROM {labels}""",
    "timings": """
SELECT 's' || CAST(user_id AS STRING) AS snapshot_id, event_type AS step, event_id AS seq, CAST(floor(value * 1000) AS BIGINT) AS elapsed FROM {events}""",
    "raw_type": """
SELECT 'T:cust.' || CAST(c_custkey AS STRING) || '|crm' AS type, CASE WHEN c_custkey % 3 = 0 THEN 'T:System.Object' ELSE 'T:nation.' || CAST(c_nationkey AS STRING) || '|geo' END AS base, 'T:i.' || c_mktsegment || '|geo' AS interface1, 'T:i.' || CAST(c_nationkey % 5 AS STRING) || '|geo' AS interface2, 'a' || CAST(c_custkey % 4 AS STRING) AS assembly, c_acctbal < 0 AS is_abstract FROM {customer}""",
    "raw_member": """
SELECT 'T:cust.' || CAST(o_custkey AS STRING) || '|crm' AS type, 'M:order.' || CAST(o_orderkey AS STRING) || '|sales' AS member, o_orderpriority AS name, o_orderstatus AS params, o_orderkey % 10 = 0 AS is_nested, o_orderkey % 7 = 0 AS is_implicit,
CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 40 <> 0 THEN 'M:order.' || CAST(o_orderkey - 5 AS STRING) || '|sales' END AS overridden, CASE WHEN o_orderkey % 4 = 0 THEN 'void' ELSE 'T:part.' || CAST(o_orderkey % 100 AS STRING) || '|inv' END AS return_type,
'T:nation.' || CAST(o_custkey % 25 AS STRING) || '|geo' AS member_type, CASE o_orderstatus WHEN 'F' THEN 'Public' WHEN 'O' THEN 'Internal' ELSE 'Private' END AS accessibility, 'T:p.' || o_orderpriority || '|geo' AS parameter1, 'T:p.' || o_orderstatus || '|geo' AS parameter2 FROM {orders}""",
    "raw_invocation": """
SELECT 'M:order.' || CAST(l_orderkey AS STRING) || '|sales' AS caller, 'T:part.' || CAST(l_partkey AS STRING) || '|inv' AS callee, 'T:supp.' || CAST(l_suppkey AS STRING) || '|inv' AS receiver, l_linenumber = 7 AS is_lambda, l_linenumber = 2 AS is_static, l_linenumber = 3 AS is_reduced, l_returnflag = 'R' AS callee_is_virtual, l_returnflag = 'A' AS is_write FROM {lineitem}""",
    "raw_site": """
SELECT 'M:user.' || CAST(user_id AS STRING) || '|web' AS caller, 'T:ev.' || CAST(event_id % 50 AS STRING) || '|web' AS target, event_type AS form, CAST(event_id % 1000 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS literal, event_id, user_id FROM {events}""",
    "turns": """
SELECT conv_id, turn, role, text, 'conv/' || CAST(conv_id AS STRING) || '.cs' AS path, 'M:conv.' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) || '|chat' AS symbol_id FROM {conversations}""",
}
#: Projections over projections, in SQL for the comparison only; in Spark the operators make them.
DERIVED = {
    "edges": f"""
SELECT src, dst, kind, provenance, doc, line, cross_generated, type_args FROM (
  SELECT src, dst, kind, provenance, doc, line, cross_generated,
    row_number() OVER (PARTITION BY src, dst, kind ORDER BY {_RANK} DESC, doc NULLS FIRST, line NULLS FIRST, cross_generated) AS rn,
    string_agg(DISTINCT type_arg, ',') OVER (PARTITION BY src, dst, kind) AS type_args0 FROM {{raw_edges}}) x
  JOIN (SELECT src AS s, dst AS d, kind AS k, string_agg(DISTINCT type_arg, ',' ORDER BY type_arg) AS type_args FROM {{raw_edges}} GROUP BY src, dst, kind) t ON src = s AND dst = d AND kind = k WHERE rn = 1""",
    "decls": """
SELECT symbol_id, path, conv_id, turn, role, text, CAST(full_start AS INT) AS full_start, CAST(full_start + strlen(text) AS INT) AS full_end FROM (
  SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_start FROM {turns}) x""",
}
DERIVED["edges"] = DERIVED["edges"].replace(",\n    string_agg(DISTINCT type_arg, ',') OVER (PARTITION BY src, dst, kind) AS type_args0", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = PROJECTIONS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def ctes(*names: str) -> str:
    """A WITH clause that defines the projections, for an engine that has the given tables as views."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out or name in TABLES:
            return
        sql = PROJECTIONS.get(name) or DERIVED[name]
        for t in re.findall(r"\{(\w+)\}", sql):
            add(t)
        out[name] = re.sub(r"\{(\w+)\}", r"\1", sql)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in out.items())
