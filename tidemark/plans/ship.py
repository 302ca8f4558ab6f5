"""Sends this package to Python workers that could not import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application.  Only where executors are on this machine can the driver's PYTHONPATH or working
    folder lead them to the package."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    here = master.startswith("local") and any(p and Path(p).resolve() == ROOT for p in paths)
    if app in _sent or here:
        return
    folder = Path(tempfile.mkdtemp(prefix="tidemark-code-"))
    shutil.copytree(ROOT / "tidemark", folder / "code" / "tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "tidemark"), "zip", folder / "code"))
    _sent.add(app)
