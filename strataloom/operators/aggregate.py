"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def completeness_summary(incompleteness: DataFrame) -> DataFrame:
    return incompleteness.groupBy("project", "reason").agg(F.sum("occurrences").alias("occurrences"))


def uncertainty_rollup(incompleteness: DataFrame) -> DataFrame:
    return incompleteness.groupBy("reason").agg(F.sum("occurrences").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Time of each step and its share in per cent; the total is joined, not taken over one window."""
    by = timings.groupBy("step").agg(F.sum("elapsed").alias("elapsed"))
    total = by.agg(F.sum("elapsed").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("step", "elapsed", F.round(F.col("elapsed") * 100.0 / F.col("total"), 1).alias("percent"))


def project_graph(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("referenced")), ",").alias("referenced"))


def snapshot_identity(docs: DataFrame, header: list[str]) -> DataFrame:
    """(snapshot_id): 32 hexadecimal digits that follow from the header and the sorted versions of all documents."""
    versions = F.array_join(F.array_sort(F.collect_list("version_id")), "\n")
    return docs.agg(F.substring(F.sha2(F.concat_ws("\n", *[F.lit(h) for h in header], versions), 256), 1, 32).alias("snapshot_id"))


def load_gate(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, document_path, reason): a record for each document of a project that can't be read (readable false)."""
    blind = projects.filter("NOT readable").select("project")
    return docs.join(blind, "project", "left_semi").select("project", F.col("path").alias("document_path"), F.lit("project_unreadable").alias("reason"))
