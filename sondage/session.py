"""Session construction and the few tunables the library reads from it."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "spark.sondage."


@dataclass(frozen=True)
class Settings:
    """Limits that decide between a one-state plan and a fully distributed one.

    ``sketch_rows``     most rows for which the built-in ``percentile`` (one value map per group)
                        is used; above it order statistics are selected with a distributed prefix sum
    ``broadcast_rows``  most rows a side may have (counted, not guessed) to be broadcast
    ``broadcast_bytes`` and most bytes, measured too
    ``bucket_rows``     rows aimed at per order bucket of a globally ordered pass
    ``buckets``         fixed number of order buckets (0: derive it from the row count)
    ``hot_share``       a join key holding more than this share of the rows is treated as hot
    """

    sketch_rows: int
    broadcast_rows: int
    broadcast_bytes: int
    bucket_rows: int
    buckets: int
    hot_share: float


_DEFAULTS = {
    "sketch_rows": 2_000_000,
    "broadcast_rows": 200_000,
    "broadcast_bytes": 32_000_000,
    "bucket_rows": 1_000_000,
    "buckets": 0,
    "hot_share": 0.002,
}


def settings(spark: SparkSession) -> Settings:
    """Read the tunables, each overridable as ``spark.sondage.<name>``."""
    values = {}
    for name, default in _DEFAULTS.items():
        raw = spark.conf.get(_PREFIX + name, None)
        values[name] = default if raw is None else type(default)(raw)
    return Settings(**values)


def build_session(app: str = "sondage", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the options the operators rely on (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several later jobs read.

    Uses the reliable checkpoint folder the cluster names, so the result survives
    executor loss; a temporary folder is set only where none is configured.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the cluster's. Only a local master may do without and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sondage-ckpt-", dir=os.environ.get("TMPDIR")))
    return sc.getCheckpointDir()
