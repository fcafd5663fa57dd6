"""Send this package to the executors, as `--py-files` would."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: Spark's own file server deals the zipped package to the workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        zipped = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        sc.addPyFile(zipped)
        _sent.add(sc.applicationId)
