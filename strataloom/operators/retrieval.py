"""Documents, spans and symbols by key or by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, line_starts, offset_to_line, slice_bytes


def document_versions(docs: DataFrame) -> DataFrame:
    """(path, version_id, content_hash, byte_count)."""
    h = content_hash("content")
    return docs.select("path", F.concat_ws(":", "path", h).alias("version_id"), h.alias("content_hash"), F.octet_length("content").alias("byte_count"))


def get_source(docs: DataFrame, path: str) -> DataFrame:
    return docs.filter(F.col("path") == path).select("path", "content")


def documents_of(docs: DataFrame, paths: DataFrame) -> DataFrame:
    return docs.join(paths.select("path"), "path", "left_semi")


def declarations(turns: DataFrame) -> DataFrame:
    """Byte spans of the turns of each conversation, joined by line feeds: (symbol_id, path, turn, role, text, full_start, full_end)."""
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("full_start", before.cast("int")).withColumn("full_end", (before + F.octet_length("text")).cast("int"))


def sources(turns: DataFrame) -> DataFrame:
    """(path, content, line_starts) of each conversation."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return turns.groupBy("path").agg(text.alias("content")).withColumn("line_starts", line_starts("content"))


def symbol_view(decls: DataFrame, docs: DataFrame) -> DataFrame:
    """(symbol_id, view): the declarations' bytes in the order of path and place, each text once, joined by an empty line; null where there is none."""
    text = slice_bytes(F.encode("content", "UTF-8"), "full_start", "full_end")
    parts = decls.select("symbol_id", "path", "full_start", "full_end").join(docs.select("path", "content"), "path").select("symbol_id", "path", "full_start", text.alias("t")).filter("t <> ''")
    once = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("path", "full_start", "t"))), lambda x: x["t"]))
    return decls.select("symbol_id").distinct().join(parts.groupBy("symbol_id").agg(F.array_join(once, "\n\n").alias("view")), "symbol_id", "left")


def declaration_locations(decls: DataFrame, docs: DataFrame) -> DataFrame:
    """0-based line and UTF-16 column of each declaration's start."""
    j = decls.filter("full_start IS NOT NULL").select("symbol_id", "path", "full_start").join(docs, "path").filter(F.col("full_start") <= F.octet_length("content"))
    line = offset_to_line("line_starts", "full_start")
    begin = F.element_at("line_starts", line + 1)
    col = F.octet_length(F.encode(slice_bytes(F.encode("content", "UTF-8"), begin, F.col("full_start")), "UTF-16LE")) / 2
    return j.select("symbol_id", "path", line.alias("line"), col.cast("int").alias("column"))


def surrounding_lines(decls: DataFrame, docs: DataFrame, n: int = 1) -> DataFrame:
    """Each declaration with n lines more on either side."""
    j = decls.select("symbol_id", "path", "full_start", "full_end").join(docs, "path")
    first, last = offset_to_line("line_starts", "full_start"), offset_to_line("line_starts", "full_end")
    size = F.octet_length("content")
    a = F.element_at("line_starts", F.greatest(first - n, F.lit(0)) + 1)
    b = F.when(last + n + 1 < F.size("line_starts"), F.get("line_starts", last + n + 1) - 1).otherwise(size)
    return j.select("symbol_id", slice_bytes(F.encode("content", "UTF-8"), a, b).alias("text"))


def navigate(decls: DataFrame, places: DataFrame, bin_bytes: int = 1 << 12) -> DataFrame:
    """(place_id, symbol_id): the innermost declaration [full_start, full_end) that holds each place (place_id, path, offset); ties by symbol_id.

    A range join as an equality join on path and a bin of offsets, each declaration in all bins it crosses.
    """
    d = decls.filter("full_end > full_start").select("path", "symbol_id", "full_start", "full_end", F.explode(F.sequence(F.floor(F.col("full_start") / bin_bytes), F.floor((F.col("full_end") - 1) / bin_bytes))).alias("bin"))
    p = places.withColumn("bin", F.floor(F.col("offset") / bin_bytes))
    hit = p.join(d, ["path", "bin"]).filter("full_start <= offset AND offset < full_end")
    return hit.groupBy("place_id").agg(F.min(F.struct((F.col("full_end") - F.col("full_start")).alias("w"), "symbol_id")).alias("b")).select("place_id", "b.symbol_id")


def symbol_info(symbols: DataFrame, decls: DataFrame) -> DataFrame:
    """Each symbol with its declarations in the snapshot: how many, and whether it has several parts."""
    n = decls.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("decl_count"))
    return symbols.join(n, "symbol_id", "left").select("symbol_id", "fqn", F.coalesce("decl_count", F.lit(0)).alias("decl_count"), (F.coalesce("decl_count", F.lit(0)) > 1).alias("is_partial"))


def resolve_fqn(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol with this name, with or without global::, else the first one whose name begins with it."""
    rank = F.when(F.col("fqn") == name, 0).when(F.col("fqn") == f"global::{name}", 1).when(F.col("fqn").startswith(name), 2)
    return symbols.withColumn("r", rank).filter("r IS NOT NULL").orderBy("r", "fqn", "symbol_id").limit(1).select("symbol_id", "fqn")


def resolve_doc_id(symbols: DataFrame, doc_id: str) -> DataFrame:
    return symbols.filter(F.col("doc_comment_id") == doc_id).orderBy("symbol_id").limit(1).select("symbol_id", "fqn")


def filter_generated(symbols: DataFrame, decls: DataFrame, mode: str) -> DataFrame:
    """decls: (symbol_id, path, is_generated). 'document': documents without a generated declaration; 'keep': symbols without a declaration, or
    with one that isn't generated; 'strict': symbols with one that isn't generated."""
    if mode == "document":
        return decls.select("path").distinct().join(decls.filter("is_generated").select("path").distinct(), "path", "left_anti")
    kinds = decls.groupBy("symbol_id").agg(F.bool_or(~F.col("is_generated")).alias("written"))
    j = symbols.select("symbol_id").join(kinds, "symbol_id", "left")
    return j.filter("written" if mode == "strict" else "coalesce(written, true)").select("symbol_id")


def public_surface(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("accessibility").isin("Public", "Protected", "ProtectedOrInternal"))
