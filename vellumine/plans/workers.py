"""Letting Python workers find the package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_code(spark: SparkSession) -> None:
    """Put the package's folder on the path of workers that see the same disk.

    Elsewhere ship it with ``--py-files`` or install it; the path is then idle.
    """
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
