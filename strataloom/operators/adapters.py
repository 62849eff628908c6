"""Plug-in point for framework rules, the registry of extractors, and what is declared not to be modelled."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Adapter(Protocol):
    name: str
    version: str

    def extract(self, staging: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """From staging tables to facts: "edges" and, if it has any, "annotations"."""


@dataclass
class Isolated:
    """What ran and what failed: a stage's failure becomes a record, the others go on."""

    edges: DataFrame | None
    failures: list[tuple[str, str]]


def run_adapters(adapters: list[Adapter], staging: dict[str, DataFrame], skip: set[str] = frozenset()) -> Isolated:
    edges, failures = None, []
    for a in adapters:
        if a.name in skip:
            continue
        try:
            e = a.extract(staging)["edges"]
        except Exception as x:
            failures.append((a.name, f"{type(x).__name__}: {x}"[:300]))
            continue
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return Isolated(edges, failures)


EXTRACTORS = [(n, "1") for n in "declarations spans metadata declares calls reads_writes constructs overrides hides returns parameters throws structure interface_dispatch virtual_dispatch static_dispatch reflection aspnet di mediatr efcore serialization tests".split()]
BOUNDARIES = [
    ("runtime_code_generation", "members made at run time have no declaration"),
    ("dynamic_binding", "calls through dynamic have no target"),
    ("external_configuration", "bindings in configuration files aren't read"),
    ("native_interop", "calls into native code end at the import"),
    ("vector_similarity", "likeness of meaning is no edge"),
    ("cross_workspace", "edges end at the workspace's border"),
]


def extractor_registry(spark: SparkSession, adapters: list[Adapter] = ()) -> DataFrame:
    return spark.createDataFrame([*EXTRACTORS, *((a.name, a.version) for a in adapters)], "name string, version string")


def declared_boundaries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOUNDARIES, "construct string, note string")
