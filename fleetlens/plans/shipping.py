"""Sends the package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of all workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "fleetlens.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*")):
            if p.suffix in (".py", ".yaml") and "__pycache__" not in p.parts:
                z.write(p, os.path.join("fleetlens", p.relative_to(top)))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
