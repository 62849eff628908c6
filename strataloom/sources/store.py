"""Snapshots in Parquet: facts by table and snapshot, published by one small manifest file that appears at once.

Layout: ``<root>/<table>/snapshot_id=<id>/…`` and ``<root>/manifests/<id>.json``. A snapshot counts once its manifest says
complete; readers never see one that is half written. Manifests are written beside their place and renamed.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMA_VERSION, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- manifests ----------------------------------------------------------------------------------------------

    def _put(self, snapshot_id: str, m: dict) -> None:
        tmp, to = self._path(f"{self.root}/manifests/.{snapshot_id}.tmp"), self._path(f"{self.root}/manifests/{snapshot_id}.json")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(to), overwrite)  # replaces the old one in one step

    def manifests(self) -> list[dict]:
        """All manifests, the newest first; ties by the greater id."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        if not any(n.endswith(".json") for n in names):
            return []
        rows = self.spark.read.text(f"{self.root}/manifests/*.json", wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: (m["built_at"], m["snapshot_id"]), reverse=True)

    def get(self, snapshot_id: str) -> dict | None:
        return next((m for m in self.manifests() if m["snapshot_id"] == snapshot_id), None)

    def latest(self, workspace_id: str | None = None, status: str = "complete") -> dict | None:
        return next((m for m in self.manifests() if m["status"] == status and workspace_id in (None, m["workspace_id"])), None)

    def latest_failure(self, workspace_id: str | None = None) -> dict | None:
        return self.latest(workspace_id, "failed")

    # --- writing ------------------------------------------------------------------------------------------------

    def publish(self, snapshot_id: str, workspace_id: str, facts: dict[str, DataFrame], built_at: datetime | None = None, **header) -> dict:
        """Writes the tables and then says complete. A complete snapshot of that id is used as it is; any failure leaves a failed manifest, and the former latest stays."""
        have = self.get(snapshot_id)
        if have and have["status"] == "complete":
            return have
        unknown = set(facts) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        previous = self.latest(workspace_id)
        m = {"snapshot_id": snapshot_id, "workspace_id": workspace_id, "built_at": (built_at or datetime.now(timezone.utc)).isoformat(), "schema_version": SCHEMA_VERSION, "status": "in_progress", "previous": previous and previous["snapshot_id"], "tables": sorted(facts)} | header
        self._put(snapshot_id, m)
        try:
            for name, df in facts.items():
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")
        except Exception as e:
            self._put(snapshot_id, m | {"status": "failed", "reason": type(e).__name__, "message": str(e)[:500]})
            raise
        m["status"] = "complete"
        self._put(snapshot_id, m)
        return m

    def read(self, name: str, snapshot_id: str) -> DataFrame:
        m = self.get(snapshot_id)
        if not m or m["status"] != "complete":
            raise ValueError(f"{snapshot_id} isn't a complete snapshot")
        if m["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"{snapshot_id} has a later schema: {m['schema_version']}")
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")

    # --- upkeep -------------------------------------------------------------------------------------------------

    def delete_payload(self, snapshot_id: str) -> None:
        for name in TABLES:
            self._fs.delete(self._path(f"{self.root}/{name}/snapshot_id={snapshot_id}"), True)

    def gc(self) -> list[tuple[str, str]]:
        """Failed snapshots lose their payload and stay as tombstones; unfinished ones go."""
        done = []
        for m in self.manifests():
            if m["status"] == "failed" and not m.get("payload_pruned"):
                self.delete_payload(m["snapshot_id"])
                self._put(m["snapshot_id"], m | {"payload_pruned": True})
                done.append((m["snapshot_id"], "tombstone"))
            elif m["status"] == "in_progress":
                self.delete_payload(m["snapshot_id"])
                self._fs.delete(self._path(f"{self.root}/manifests/{m['snapshot_id']}.json"), False)
                done.append((m["snapshot_id"], "delete"))
        return done

    def prune(self, keep: int = 3) -> list[str]:
        """Keeps the `keep` newest snapshots of each workspace, of whatever status; pointers to those that go are mended."""
        seen: dict[str, int] = {}
        gone = []
        for m in self.manifests():
            seen[m["workspace_id"]] = seen.get(m["workspace_id"], 0) + 1
            if seen[m["workspace_id"]] > keep:
                gone.append(m["snapshot_id"])
        for s in gone:
            self._fs.delete(self._path(f"{self.root}/manifests/{s}.json"), False)
            self.delete_payload(s)
        for m in self.manifests():
            if m.get("previous") in gone:
                self._put(m["snapshot_id"], m | {"previous": None})
        return gone
