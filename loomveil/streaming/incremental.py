"""Incremental masking and embedding: file streams that process what is new and stop."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.sources.snapshots import SnapshotTable

STATUS = "fingerprint string, run int, batch_id bigint, rows bigint, rows_a_second double, at string"


def fingerprint(settings: dict) -> str:
    """The digest of what a run's results depend on: columns, layers, settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], kind: str = "parquet", settings: dict | None = None, status: str | None = None) -> int:
    """Reads files that no earlier run has read, writes their rows once per batch id, returns the
    number of batches.  A repeated batch overwrites its own folder, so a broken run leaves no doubles.

    With settings, target and checkpoint get a folder of their fingerprint: a run with the same settings goes
    on, and one with others starts anew beside it.  status is a table of the progress of all runs."""
    done, name = [], "" if settings is None else fingerprint(settings)
    target, checkpoint = (f"{target}/{name}", f"{checkpoint}/{name}") if name else (target, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        done.append(batch_id)

    stream = spark.readStream.schema(schema).format(kind).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if status:
        _note(spark, status, name, [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress])
    return len(done)


def _note(spark: SparkSession, status: str, name: str, progress: list[dict]) -> None:
    """Adds the progress of a run, a row a batch."""
    table = SnapshotTable(spark, status, STATUS)
    run = (table.load().where(F.col("fingerprint") == name).agg(F.max("run")).first()[0] or 0) + 1
    rows = [(name, run, p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0), p["timestamp"]) for p in progress if p["numInputRows"]] or [(name, run, None, 0, 0.0, None)]
    fresh = spark.createDataFrame(rows, STATUS)
    table.commit(lambda now: now.unionByName(fresh), "run")


def run_status(spark: SparkSession, status: str) -> DataFrame:
    """(fingerprint, runs, batches, rows, last) of all settings that were run."""
    rows = SnapshotTable(spark, status, STATUS).load()
    return rows.groupBy("fingerprint").agg(F.max("run").alias("runs"), F.count("batch_id").alias("batches"), F.sum("rows").alias("rows"), F.max("at").alias("last"))


def results(spark: SparkSession, target: str, settings: dict, schema) -> DataFrame:
    """What runs with these settings have written."""
    return spark.read.schema(schema).parquet(f"{target}/{fingerprint(settings)}")


class Overviews:
    """Tables by filters, computed once for each version of their source and read from the store afterwards."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    def get(self, filters: dict[str, str], make: Callable[[dict[str, str]], DataFrame]) -> DataFrame:
        kept = {k: v for k, v in sorted(filters.items()) if v not in (None, "", "All")}
        df = make(kept)
        table = SnapshotTable(self.spark, f"{self.path}/{fingerprint({'version': self.version, 'filters': kept})}", df.schema)
        if not table.version():
            table.commit(lambda now: df, json.dumps(kept))
        return table.load()


def only_new(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(key), key, "left_anti")
