"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once: their Python need not have it."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parents[0]
    if getattr(sc, "_shipped", None) == str(top) or not top.is_dir():  # from a zip, it has been sent already
        return
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"  # the driver serves it from here as long as it runs
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._shipped = str(top)
