"""Sends this package to the Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; workers import the package as the driver has it."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quarry/{p.relative_to(root)}")
    context.addPyFile(path)
