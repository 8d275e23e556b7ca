"""Session settings for this engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def build(name: str = "strandlake", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and last-wins map keys; ``conf`` overrides by dotted name."""
    builder = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items() | conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let the workers import this package where their path doesn't lead to it: sent once, as a zip, with the application."""
    root = Path(__file__).resolve().parent.parent
    paths = [Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in paths or _SHIPPED.get("to") == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/strandlake", "zip", root, "strandlake"))
    _SHIPPED["to"] = spark.sparkContext.applicationId
