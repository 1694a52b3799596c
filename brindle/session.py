"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; below a local one where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{base.rstrip('/')}/brindle-{uuid.uuid4().hex}"
