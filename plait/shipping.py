"""Sending the package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package once for each context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if not getattr(sc, "_plait_shipped", False):
        sc._plait_shipped = True
        root = Path(__file__).resolve().parent.parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='plait-')}/plait", "zip", root, "plait"))
