"""Snapshots of a table with an append-only log of what was done to it."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOG = "version int, name string, recorded timestamp_ntz, rows long, cols int, changes string, stored string"


class VersionedTable:
    """A Parquet folder of its own name for each version's data under ``root`` and a numbered log entry for each version.

    A commit writes its data, then puts the entry of the next number, whole and only if that number is free. So of two writers
    that start from the same version one gets the number and the other raises; a writer that dies leaves a folder that no entry
    names, and hinders nobody. A restore stores no data: its entry names the folder of the version it brings back.

    Entries rely on the file system refusing to rename onto a file that exists (HDFS) or to link to it (local paths).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        """(version, name, recorded, rows, cols, changes), one row per version."""
        return self._log().drop("stored")

    def _log(self) -> DataFrame:
        fs, path = self._at(f"{self.root}/log")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).json(f"{self.root}/log", mode="FAILFAST")

    def latest(self) -> int:
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def commit(self, df: DataFrame, name: str | None = None, changes: str = "") -> int:
        """Store ``df`` as the next version and log it; returns the version number."""
        version = self.latest() + 1
        if version == 1 and name is None:
            name, changes = "Original Dataset", changes or "Initial upload"
        stored = f"v{version:06d}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{stored}")
        data = self.spark.read.parquet(f"{self.root}/{stored}")
        self._record(version, name or f"Step {version}", changes, data.count(), len(data.columns), stored)
        return version

    def _record(self, version: int, name: str, changes: str, rows: int, cols: int, stored: str) -> None:
        entry = {
            "version": version,
            "name": name,
            "recorded": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds"),
            "rows": rows,
            "cols": cols,
            "changes": changes,
            "stored": stored,
        }
        if not self._put(f"log/{version:06d}.json", json.dumps(entry) + "\n"):
            raise AnalysisException(f"version {version} was committed by another writer; load it and commit again")

    def _put(self, name: str, text: str) -> bool:
        """Make a file with all of ``text`` unless there is one of that name; tells whether it was made."""
        fs, target = self._at(f"{self.root}/{name}")
        _, draft = self._at(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() != "file":
                return fs.rename(draft, target)
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            fs.delete(draft, False)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(path)

    def load(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._entry(version or self.latest())['stored']}")

    def _entry(self, version: int):
        row = self._log().where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"no version {version}")
        return row

    def restore(self, version: int) -> DataFrame:
        """Bring back an earlier version; the restore is itself logged as a new version."""
        old = self._entry(version)
        new = self.latest() + 1
        self._record(new, f"Restored V{version}", f"Reverted back to Version {version}", old["rows"], old["cols"], old["stored"])
        return self.load(new)

    def reset(self) -> DataFrame:
        """Return to the first version."""
        return self.restore(1)

    def audit_log(self) -> DataFrame:
        """Ordered list of applied actions."""
        return self.log().where(F.col("version") > 1).select("version", "changes").orderBy("version")
