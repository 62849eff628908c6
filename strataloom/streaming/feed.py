"""A feed of changed documents kept up as a stream: each batch refreshes the edges of its documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.store import Store


def follow(spark: SparkSession, changes: str, schema: str, store: Store, workspace_id: str, derive: Callable[[DataFrame], DataFrame], checkpoint: str, symbols: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads files of changes (doc, …) as they appear and publishes a snapshot for each batch, as a refresh of the engine does.

    derive: from a batch's changed documents to their edges before deduplication (src, dst, kind, provenance, doc, line, cross_generated, type_arg); a document
    that went has none. symbols: from a batch to the symbols that there are after it; without it those of the last snapshot
    and all ends of the batch's edges. A batch that is run again has the same snapshot id, so it is published once.
    """
    engine = Engine(spark, store.root, workspace_id)

    def batch(df: DataFrame, number: int) -> None:
        raw, scope = derive(df), df.select("doc").distinct()
        if symbols is not None:
            now = symbols(df)
        else:
            ends = raw.select(F.col("src").alias("symbol_id")).union(raw.select("dst")).distinct()
            now = ends.join(engine.table("symbols"), "symbol_id", "full").select("symbol_id", *(c for c in engine.table("symbols").columns if c != "symbol_id")) if store.latest(workspace_id) else ends
        engine.refresh(f"{workspace_id}-batch-{number:010d}", now, scope, raw)

    return spark.readStream.schema(schema).parquet(changes).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def counts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window of time, with a watermark; on a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
