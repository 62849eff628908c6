"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh, shared_table

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(__h1, __h2, __id, __th, __pos) for each three consecutive lines of a document that aren't all blank."""
    lines = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.split("text", "\n").alias("__l"))

    def one(i):
        three = [F.get(F.col("__l"), i + F.lit(k)) for k in range(WINDOW)]
        blank = F.length(F.trim(F.concat(*three))) == 0
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(7), *three).alias("h2"), blank.alias("blank"))

    return (
        lines.filter(F.size("__l") >= WINDOW)
        .select("__id", "__th", F.explode(F.transform(F.sequence(F.lit(0), F.size("__l") - F.lit(WINDOW)), one)).alias("__w"))
        .filter("not __w.blank")
        .select(F.col("__w.h1").alias("__h1"), F.col("__w.h2").alias("__h2"), "__id", "__th", F.col("__w.pos").alias("__pos"))
    )


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the lines removed that a later occurrence of a window covers; adds __n_lines, __n_removed.

    A window is three consecutive lines, compared exactly (128 bits of hash stand for them).
    Of all its occurrences in the corpus the first by (doc_id, hash of the text, line) stays; the lines
    covered by any other are removed, overlapping ones once. Windows of blank lines only
    are not considered, and documents of fewer than three lines stay as they are. A row with a null
    doc_id or text is passed on unchanged (null text: __n_lines null, 0 removed). Repeated rows
    (same doc_id and text) count as one document and all get the same result; rows of one
    doc_id with different texts are different documents. Empty table: empty.

    Shuffles: 40 bytes a window (twice), and the texts once by document. The first
    occurrence is a partial aggregate, so a window that everyone has is no hot partition there; the join
    back is a sort-merge join that adaptive execution splits where it is skewed. The texts are joined to the covered
    positions by hash, so they aren't sorted, and in the same way at every size.
    """
    w = shared_table(spark, windows(docs), "windows")
    here = F.struct("__id", "__th", "__pos")
    first = w.groupBy("__h1", "__h2").agg(F.min(here).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    later = w.join(first, ["__h1", "__h2"]).filter(here != F.col("__first"))
    covered = shared_table(spark, later.groupBy("__id", "__th").agg(F.sort_array(F.collect_set("__pos")).alias("__at")), "covered")
    keep = [c for c in docs.columns if c.lower() not in {"__n_lines", "__n_removed"}]
    docs = docs.select(*keep)
    id_, th, at, key = (fresh(docs, x) for x in ("__id", "__th", "__at", "__key"))
    lines, cover = F.split("text", "\n"), F.flatten(F.transform(at, lambda p: F.array(*[p + F.lit(k) for k in range(WINDOW)])))
    left = F.array_except(F.sequence(F.lit(0), F.col("__n_lines") - 1), cover)
    new = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = docs.withColumns({key: F.xxhash64("text"), "__n_lines": F.when(F.col("text").isNotNull(), F.size(lines))})
    covered = covered.select(F.col("__id").alias(id_), F.col("__th").alias(th), F.col("__at").alias(at))
    out = out.join(covered.hint("shuffle_hash"), (F.col("doc_id") == F.col(id_)) & (F.col(key) == F.col(th)), "left")
    hit = F.col(at).isNotNull() & F.col("text").isNotNull()
    out = out.withColumn("__n_removed", F.when(hit, F.col("__n_lines") - F.size(left)).otherwise(0))
    return out.withColumn("text", F.when(hit, new).otherwise(F.col("text"))).select(*keep, "__n_lines", "__n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def _sql(table: str, columns: str) -> str:
    return rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS pos
  FROM {table} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT * FROM (
    SELECT doc_id, text, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS w
    FROM lines WINDOW o AS (PARTITION BY doc_id, text ORDER BY pos)) WHERE w IS NOT NULL AND length(trim(replace(w, chr(10), ''))) > 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, text, pos + k AS pos FROM seen, (VALUES (0), (1), (2)) v(k) WHERE rn > 1),
cut AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS new, CAST(count(g.pos) AS INTEGER) AS n_removed, CAST(count(*) AS INTEGER) AS n_lines
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.pos = g.pos GROUP BY l.doc_id, l.text)
SELECT d.doc_id, CASE WHEN c.n_removed > 0 THEN coalesce(c.new, '') ELSE d.text END AS text, c.n_lines, coalesce(c.n_removed, 0) AS n_removed{columns}
FROM {table} d LEFT JOIN cut c ON d.doc_id = c.doc_id AND d.text = c.text
"""


OP2_SQL = _sql("documents", "")
