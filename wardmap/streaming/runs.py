"""A table kept in step with a stream: levels of sorted runs by key bucket, and a manifest of the live ones.

A batch becomes a run of level 0. When a level has ``FAN_IN`` runs they are folded into one of the next level, and the last
level folds into a single run, so a read touches at most ``(FAN_IN - 1) * (LEVELS - 1) + 1`` runs of a bucket, whatever the
number of batches. Runs are written before the manifest that names them; a batch that is in the manifest already
changes nothing, and one that was cut short overwrites its own run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import child_names, delete_folder

FAN_IN, LEVELS, BUCKETS = 4, 6, 16


@dataclass(frozen=True)
class Manifest:
    """The last batch, the live runs as (level, name), and the schema of their rows (JSON)."""

    batch: int = -1
    runs: tuple[tuple[int, str], ...] = ()
    schema: str = ""


@dataclass(frozen=True)
class RunTable:
    """``fold`` reduces any rows to one per key; folding folded rows must give what folding all at once does."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]
    fan_in: int = FAN_IN
    levels: int = LEVELS
    buckets: int = BUCKETS

    def manifest(self) -> Manifest:
        written = sorted(child_names(self.spark, f"{self.path}/manifest"))
        # A manifest counts once Spark has marked its folder as complete.
        for name in reversed(written):
            if "_SUCCESS" in child_names(self.spark, f"{self.path}/manifest/{name}"):
                rows = self.spark.read.parquet(f"{self.path}/manifest/{name}").collect()
                runs = tuple(sorted((r.level, r.run) for r in rows if r.run))
                return Manifest(int(name), runs, rows[0].schema)
        return Manifest()

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; one that has been added before is left out."""
        before = self.manifest()
        if batch <= before.batch:
            return
        folded = self.fold(rows)
        schema, runs = folded.schema.json(), list(before.runs)
        runs.append(self._write(folded, 0, batch))
        for level in range(self.levels - 1):
            full = [r for r in runs if r[0] == level]
            if len(full) < self.fan_in:
                break
            if level + 1 == self.levels - 1:
                full += [r for r in runs if r[0] == level + 1]
            merged = self._write(self.fold(self._read(full, schema)), level + 1, batch)
            runs = [r for r in runs if r not in full] + [merged]
        listed = [(level, run, schema) for level, run in runs]
        self.spark.createDataFrame(listed, "level int, run string, schema string").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/manifest/{batch:012d}")
        self._tidy(before, {run for _, run in runs})

    def read(self) -> DataFrame | None:
        """One row per key, or None before the first batch."""
        found = self.manifest()
        return self.fold(self._read(found.runs, found.schema)) if found.runs else None

    def _write(self, rows: DataFrame, level: int, batch: int) -> tuple[int, str]:
        name = f"{level}-{batch:012d}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/{name}")
        return level, name

    def _read(self, runs, schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/runs/{name}") for _, name in runs]
        whole = parts[0].select(kind.names)
        for part in parts[1:]:
            whole = whole.unionByName(part.select(kind.names))
        return whole

    def _tidy(self, before: Manifest, live: set[str]) -> None:
        """Delete runs that neither this manifest nor the one before names, and the manifests before that."""
        keep = live | {run for _, run in before.runs}
        for name in child_names(self.spark, f"{self.path}/runs"):
            if name not in keep:
                delete_folder(self.spark, f"{self.path}/runs/{name}")
        for name in sorted(child_names(self.spark, f"{self.path}/manifest"))[:-2]:
            delete_folder(self.spark, f"{self.path}/manifest/{name}")
