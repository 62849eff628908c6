"""Schemas of the fact tables and the version of their layout."""

from __future__ import annotations

SCHEMA_VERSION = 1

TABLES = {
    "documents": "path string, project string, content string, content_hash string, version_id string",
    "symbols": "symbol_id string, doc_comment_id string, assembly string, kind string, fqn string, accessibility string, is_abstract boolean, type_kind string",
    "declarations": "symbol_id string, path string, full_start int, full_end int, is_partial boolean, is_generated boolean, generator_identity string",
    "edges": "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_args string",
    "raw_edges": "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_arg string",
    "nodes": "symbol_id string",
    "annotations": "seq bigint, symbol_id string, kind string, value string, document_path string",
    "diagnostics": "seq bigint, project string, severity string, id string, line int, message string",
    "incompleteness": "project string, document_path string, reason string, occurrences bigint",
    "timings": "seq bigint, step string, elapsed bigint",
    "semantic_changes": "symbol_id string, change string, detail string",
    "extractors": "name string, version string",
}
#: Primary keys: of several rows with one key the last seq, or the first, counts.
KEYS = {"symbols": ["symbol_id"], "declarations": ["symbol_id", "path", "full_start"], "edges": ["src", "dst", "kind"], "documents": ["path"], "incompleteness": ["project", "document_path", "reason"]}
#: The column of the document that a fact belongs to, where the table has such facts: they come anew with their document.
DOCUMENT = {"documents": "path", "declarations": "path", "incompleteness": "document_path"}
