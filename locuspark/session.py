"""Session defaults for marker-partitioned work."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Conservative bound on the samples of one analysis: n x n objects live on the driver and in broadcasts.
MAX_SAMPLES = 8000


def build_session(name: str = "locuspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` holds further settings, dots as ``__``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors reach: where ``spark.checkpoint.dir`` says, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def batch_markers(n_samples: int, workspace_mib: float = 32.0, most: int = 4096) -> int:
    """Marker rows of an Arrow batch whose dosages take up the workspace at most."""
    if isinstance(workspace_mib, bool) or not isinstance(workspace_mib, (int, float)) or not workspace_mib > 0 or workspace_mib == float("inf"):
        raise ValueError("marker_workspace_mib must be a finite positive number")
    return max(1, min(most, int(workspace_mib * (1 << 20) // (8 * max(1, n_samples)))))
