"""What a session needs: the package in its Python workers, and a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local temporary folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="turnback-")
        base = _local[app]
    return base.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once for a Spark application."""
    sc = spark.sparkContext
    if spark.conf.get("spark.turnback.shipped", "") != sc.applicationId:
        root = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="turnback-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        spark.conf.set("spark.turnback.shipped", sc.applicationId)
    return spark
