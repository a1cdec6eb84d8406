"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, as they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_helixframe_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    # The driver serves the file from its place, so the folder stays as long as the driver does.
    path = Path(tempfile.mkdtemp(prefix="helixframe-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    context._helixframe_shipped = True
