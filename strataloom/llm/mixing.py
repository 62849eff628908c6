"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh, shared_table

TOKEN = r"[^ \t\n\r]+"


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None) -> DataFrame:
    """One row (__source, tokens, rate) for each source, null being a source of its own.

    targets: weight by source, 0 for a source that isn't named; None: tokens ** alpha.
    budget: tokens to emit in all; None: as many as there are. A source without any
    token has the rate 1.
    """
    by = docs.groupBy(F.col("source").alias("__source")).agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(TOKEN))), F.lit(0)).cast("bigint").alias("tokens"))
    if targets is None:
        weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(F.lit(0.0))
    else:
        weight = F.lit(0.0)
        for name, value in targets.items():
            weight = F.when(F.col("__source") == name, F.lit(float(value))).otherwise(weight)
    by = by.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)))
    whole = by.agg(F.sum("weight").alias("weights"), F.sum("tokens").alias("all_tokens"))
    want = F.lit(float(budget)) if budget is not None else F.col("all_tokens")
    rate = F.when((F.col("tokens") > 0) & (F.col("weights") > 0), F.round(F.col("weight") / F.col("weights") * want / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    return by.crossJoin(whole).select("__source", "tokens", rate.alias("rate"))


def mix_sources(spark: SparkSession, docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None, seed: int = 17) -> DataFrame:
    """Emits each row floor(rate) times and once more with probability rate - floor(rate).

    The draw is the first 32 bits of md5("seed:doc_id") / 2**32, so it is the same in every
    run and on every partitioning. Output: the columns of docs and ``copy`` from 1 (a column
    of that name in the input is replaced). Repeated rows are emitted each on its own, with
    the same draw. A null text has no tokens but is emitted like its source's other rows; a
    null doc_id draws as an empty one; rows of a null source are a source. Empty table: empty.

    Two scans of docs, and a shuffle of a row per source and map task. Rates are one row per
    source, written to the shared folder; Spark broadcasts them only while their files
    are below spark.sql.autoBroadcastJoinThreshold, else it joins by shuffle.
    """
    src, rate, n = (fresh(docs, x) for x in ("__source", "__rate", "__copies"))
    rates = shared_table(spark, source_rates(docs.select("source", "text"), targets, alpha, budget).select(F.col("__source").alias(src), F.col("rate").alias(rate)), "rates")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    copies = (F.floor(rate) + F.when(draw < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    keep = [c for c in docs.columns if c.lower() != "copy"]
    return (
        docs.join(rates, F.col("source").eqNullSafe(F.col(src)))
        .withColumn(n, copies)
        .filter(F.col(n) > 0)
        .select(*keep, F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy"))
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH by_source AS (
  SELECT source, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS BIGINT) AS tokens
  FROM documents GROUP BY source),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens, 0.7) ELSE 0 END AS weight FROM by_source),
r AS (SELECT source, CASE WHEN tokens > 0 THEN round(weight / (SELECT sum(weight) FROM w) * (SELECT sum(tokens) FROM w) / tokens, 9) ELSE 1.0 END AS rate FROM w),
c AS (
  SELECT d.*, CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM c WHERE copies > 0
"""
