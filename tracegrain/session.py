"""Session set-up: settings for a new session, and what an existing one needs for the package's own tasks."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the package's settings; partitions default to the local cores."""
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions or os.cpu_count() or 8)} | more
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a folder all can see, or local mode)."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; where it is unset, a new local one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found
