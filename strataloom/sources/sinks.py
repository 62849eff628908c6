"""Renderings of results: JSON, lines of JSON with a head, a summary; and bundles as files."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_jsonl(df: DataFrame, path: str, meta: dict) -> None:
    """Lines of JSON in a folder; the first file holds the head, a line of its own."""
    head = df.sparkSession.createDataFrame([(json.dumps({"meta": meta}, sort_keys=True),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/_meta=0")
    to_json(df).write.mode("overwrite").text(f"{path}/_meta=1")


def summary(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def write_capsule(capsule: dict, folder: str, symbol: str, longest: int = 120) -> str:
    """One file for a bundle; a long name ends in a hash."""
    name = "".join(c if c.isalnum() or c in "._-" else "_" for c in symbol)
    if len(name) > longest:
        name = name[: longest - 17] + "-" + hashlib.sha256(symbol.encode()).hexdigest()[:16]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name + ".json")
    with open(path, "w") as f:
        json.dump(capsule, f, sort_keys=True)
    return path
