"""Tables that stream batches append to or replace, each batch exactly once.

A store is a folder with a folder per table and a folder of manifests. A batch first writes its tables
under a name of its own attempt and then publishes one small manifest that lists them. Readers look
at manifests only: what an interrupted batch has written is never seen, and a batch that is
replayed after its publication finds its manifest and writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Tables under ``root``, written by the stream ``app``: a batch is known by (app, epoch)."""

    def __init__(self, spark: SparkSession, root: str, app: str = "main"):
        self.spark, self.root, self.app = spark, root.rstrip("/"), app
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests ----------------------------------------------------------------------------

    def _manifest(self, epoch: int) -> str:
        return f"{self.root}/_published/{self.app}-{epoch:012d}.json"

    def _load(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifests(self, before: int | None = None) -> list[dict]:
        """Published batches in order, from the last one that replaces all earlier ones; optionally only epochs below ``before``."""
        at = self._path(f"{self.root}/_published")
        if not self._fs.exists(at):
            return []
        files = sorted((f.getPath() for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")), key=lambda p: p.getName())
        found = [self._load(p) for p in files if p.getName().startswith(f"{self.app}-")]
        found = [m for m in found if before is None or m["epoch"] < before]
        base = max((i for i, m in enumerate(found) if m["replaces"]), default=0)
        return found[base:]

    def epochs(self) -> list[int]:
        return [m["epoch"] for m in self.manifests()]

    def is_published(self, epoch: int) -> bool:
        """Also true for an epoch that a later compaction has taken up."""
        found = self.manifests()
        return self._fs.exists(self._path(self._manifest(epoch))) or bool(found and found[0]["replaces"] and epoch <= found[0]["epoch"])

    def _publish(self, path: str, epoch: int, tables: dict[str, str], replaces: bool) -> bool:
        """Written aside and renamed, so a manifest is there whole or not at all; a rename never replaces one."""
        aside = self._path(f"{self.root}/_published/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"epoch": epoch, "tables": tables, "replaces": replaces}).encode()))
        out.close()
        done = not self._fs.exists(self._path(path)) and self._fs.rename(aside, self._path(path))
        if not done:
            self._fs.delete(aside, False)
        return done

    # -- tables -------------------------------------------------------------------------------

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """Published rows of a table; None before the first batch that wrote it."""
        paths = [m["tables"][table] for m in self.manifests(before) if table in m["tables"]]
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in paths]) if paths else None

    def commit(self, epoch: int, tables: Mapping[str, DataFrame], replaces: bool = False) -> bool:
        """Write the tables of one batch and publish them; False if the batch had been published before.

        ``replaces``: the batch holds whole tables, and earlier batches are no longer read.
        """
        if self.is_published(epoch):
            return False
        written = {}
        for name, df in tables.items():
            written[name] = f"{name}/epoch-{epoch:012d}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{written[name]}")
        return self._publish(self._manifest(epoch), epoch, written, replaces)

    def compact(self, files: int = 1) -> None:
        """Put all published batches into one that replaces them; readers see the old batches or the new one, the same rows either way."""
        found = self.manifests()
        if len(found) < 2:
            return
        last, written = found[-1]["epoch"], {}
        for name in sorted({t for m in found for t in m["tables"]}):
            written[name] = f"{name}/upto-{last:012d}-{uuid.uuid4().hex}"
            self.read(name).coalesce(files).write.parquet(f"{self.root}/{written[name]}")
        self._publish(self._manifest(last).replace(".json", ".upto.json"), last, written, True)

    def vacuum(self) -> int:
        """Delete folders that no manifest in use names: interrupted attempts and batches that were replaced. Run while no batch is written."""
        used = {p for m in self.manifests() for p in m["tables"].values()}
        gone = 0
        for t in self._fs.listStatus(self._path(self.root)):
            name = t.getPath().getName()
            if name.startswith("_"):
                continue
            for f in self._fs.listStatus(t.getPath()):
                if f"{name}/{f.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone


def exactly_once(store: TableStore, body: Callable[[DataFrame, int], Mapping[str, DataFrame]], replaces: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``body(batch, epoch)`` gives the tables, the store takes them once."""

    def run(batch: DataFrame, epoch: int) -> None:
        if not store.is_published(epoch):
            store.commit(epoch, body(batch, epoch), replaces)

    return run
