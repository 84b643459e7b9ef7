"""Lets Python workers import this package where the cluster doesn't provide it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless PYTHONPATH or the working folder has it already."""
    app = spark.sparkContext.applicationId
    if app in _sent or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT:
        return
    archive = Path(tempfile.mkdtemp(prefix="halyard-")) / "halyard.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (ROOT / "halyard").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
