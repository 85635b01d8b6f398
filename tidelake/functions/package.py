"""Sending this package to the executors, so that Python workers on other machines can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def send(spark: SparkSession | None = None) -> None:
    """Once per application; without a session given, that of the active one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SENT:
        return
    fd, name = tempfile.mkstemp(prefix="tidelake_", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(name)
    _SENT.add(spark.sparkContext.applicationId)
