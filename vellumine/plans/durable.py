"""Cutting lineage with tables in the shared checkpoint folder.

A written table survives the loss of executors, and ends the lineage of loops.
The folder is the one that ``spark.checkpoint.dir`` names, which every executor
sees.  Where it is unset, a master on one machine (tests, a laptop) gets a
temporary folder, which goes when Python ends; a cluster gets an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths given out inside each open ``scratch``.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the shared folder; nothing is created there yet."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="vellumine-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = "file://" + folder
        root = _own[app]
    path = f"{root.rstrip('/')}/vellumine/{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at its end every table and folder that operators made inside it.

    A lazy result reads such tables, so it is to be written, or collected, inside too.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        # by identity, as several may hold the same
        del _open[next(k for k, x in enumerate(_open) if x is paths)]
        discard(spark, paths)


#: Drops shuffle files at the end of an action, where Spark knows the setting.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, keep: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    ``keep`` collects the paths, so that a caller can ``discard`` them later.
    Nothing reads the shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, as a table; of all else that it wrote nothing stays."""
    with scratch(spark) as paths:
        kept: list[str] = []
        out = materialise(make(), kept)
        paths[:] = [p for p in paths if p not in kept]
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no later read needs."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
