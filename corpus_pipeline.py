"""A training corpus from raw documents: language ID, line dedup, near dedup, decontamination, mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor kept; its result is
written as Parquet and read again as the next one's docs.

Other columns pass through every stage whatever their names, and an empty table passes as one. Texts may have any length. Documents with a null or
empty text, or without a letter, leave in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm._io import shared_table
from strataloom.llm.decontam import decontaminate
from strataloom.llm.langid import identify
from strataloom.llm.line_dedup import dedup_lines
from strataloom.llm.mixing import mix_sources
from strataloom.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those with a null text, no letter or another language go, and all where no row has a label; repeated rows fare alike."""
    return identify(spark, docs).filter("__accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that has no line left goes. n_chars is counted anew where lines went. Rows with a null id or text stay as they are."""
    out = dedup_lines(spark, docs).filter((F.col("__n_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id; rows with a null id or text and those without a word stay, repeated rows of one doc_id stay together."""
    return drop_near_duplicates(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; rows with a null text stay. An empty benchmark takes none away."""
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its source's rate, numbered in `copy`, which replaces a column of that name. Rows of a null source are a source of their own."""
    return mix_sources(spark, docs)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near), ("benchmark decontamination", benchmark), ("mixing", mix)]
#: Language ID and SimHash can't be told in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(spark, docs, f"stage{k}")
    return docs
