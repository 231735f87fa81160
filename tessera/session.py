"""What every entry point needs of a Spark session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tessera-"))
    with zipfile.ZipFile(f"{folder}/tessera_package.zip", "w") as z:
        for p in sorted((root / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{folder}/tessera_package.zip")
    sc._tessera_shipped = True
