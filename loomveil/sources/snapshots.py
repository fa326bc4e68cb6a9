"""Tables that are replaced as a whole: immutable data folders and numbered manifests.

A commit writes a data folder, then the manifest of the next number, which appears under its name in one
rename that fails if the name exists.  Readers take the manifest of the highest number.  A writer that stops
before the rename leaves a folder that no manifest names; one that loses a race reads the newer table and
tries again.  A manifest that cannot be read is an error, never a reason to read an older table.

The rename is atomic where the store's is (HDFS, local disks); object stores need a committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _java(self):
        return self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str):
        jvm, conf = self._java()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(conf), at

    def version(self) -> int:
        """The number of the newest snapshot; 0: none."""
        fs, at = self._at("manifests")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        fs, at = self._at(f"manifests/{version}")
        stream = fs.open(at)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError as e:
            raise ValueError(f"manifest {version} of {self.path} is damaged") from e
        finally:
            stream.close()
        if found.get("version") != version or "folder" not in found:
            raise ValueError(f"manifest {version} of {self.path} is damaged")
        return found

    def load(self, version: int | None = None) -> DataFrame:
        """The newest snapshot, or an older one that is kept."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.manifest(version)['folder']}")

    def commit(self, change: Callable[[DataFrame], DataFrame], note: str = "", tries: int = 5) -> int:
        """Makes change(newest snapshot) the next one; returns its number."""
        for _ in range(tries):
            version = self.version()
            folder = f"data-{version + 1}-{uuid.uuid4().hex}"
            current = self.load(version)
            change(current).select(current.columns).write.parquet(f"{self.path}/{folder}")
            if self._publish(version + 1, {"version": version + 1, "folder": folder, "note": note}):
                return version + 1
        raise RuntimeError(f"{self.path} changed {tries} times while it was being written")

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether the manifest is now the one of its number."""
        jvm, conf = self._java()
        fs, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.mkdirs(self._at("manifests")[1])
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), conf)
            context.rename(draft, self._at(f"manifests/{version}")[1], none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                fs.delete(draft, False)
                return False
            raise
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes what the newest snapshots do not need.  No reader of an older one, and no writer, may be at work."""
        newest = self.version()
        kept = {self.manifest(v)["folder"] for v in range(max(1, newest - keep + 1), newest + 1) if self._at(f"manifests/{v}")[0].exists(self._at(f"manifests/{v}")[1])}
        fs, at = self._at("")
        for s in fs.listStatus(at):
            if s.getPath().getName().startswith("data-") and s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)
        for v in range(newest - keep, 0, -1):
            fs, at = self._at(f"manifests/{v}")
            if not fs.exists(at):
                break
            fs.delete(at, False)
