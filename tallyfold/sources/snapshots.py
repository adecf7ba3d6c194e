"""Tables that belong together, replaced as one.

Every write puts its tables in a new folder and then adds a manifest that names, for
each table, the folder that counts. Readers go by the last manifest, so they see all
tables of a write or none; a write that stops before its manifest leaves nothing but
a folder that no manifest names. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_system


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        system, where = file_system(self.spark, f"{self.path}/manifests")
        if not system.exists(where):
            return []
        names = [status.getPath().getName() for status in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folders by table; empty before the first write."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version:012d}.json").collect()))

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Replaces the given tables together, others stay; gives the new version."""
        folder = f"data/{uuid.uuid4().hex}"
        held = self.manifest()
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/{folder}/{name}")
            held[name] = f"{folder}/{name}"
        return self._commit(held)

    def _commit(self, held: dict[str, str]) -> int:
        """A manifest is written aside and then named, so that no reader finds half of one."""
        version = (self.versions() or [0])[-1] + 1
        system, aside = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = system.create(aside)
        stream.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        stream.close()
        _, target = file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
        if system.exists(target) or not system.rename(aside, target):
            raise RuntimeError(f"version {version} of {self.path} was written by another")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if name not in held:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{held[name]}")

    def drop_unnamed(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` manifests, and the folders that none of these names."""
        known = self.versions()
        named = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v).values()}
        for version in known[:-keep]:
            system, where = file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
            system.delete(where, False)
        system, where = file_system(self.spark, f"{self.path}/data")
        if system.exists(where):
            for status in system.listStatus(where):
                if status.getPath().getName() not in named:
                    system.delete(status.getPath(), True)
