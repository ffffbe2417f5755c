"""The package on the executors, also where it isn't installed and the driver only has it on its own path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_palimpsest_sent"


def ship(spark: SparkSession) -> None:
    """Add this package to the context's Python files, once a context; executors fetch it from the driver."""
    sc = spark.sparkContext
    if getattr(sc, _SENT, False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="palimpsest-"))
    copy = folder / "tree" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "tree"))
    shutil.rmtree(folder / "tree")
    setattr(sc, _SENT, True)
