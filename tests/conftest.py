from __future__ import annotations

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows with columns by name, as sorted strings."""
    names = sorted(frame.columns)
    return sorted(tuple("null" if pd.api.types.is_scalar(v) and pd.isna(v) else str(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))


def shared_tables(spark) -> set[str]:
    """What stands in the shared folder."""
    from vellumine.plans.durable import shared_dir

    root = shared_dir(spark).rsplit("/", 1)[0].removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its oracle on the smallest tables, and sees that nothing is left of its scratch tables."""
    from vellumine.plans.durable import scratch

    def check(query, sql):
        before = shared_tables(spark)
        with scratch(spark):
            mine = query(spark, DATA).toPandas()
        assert shared_tables(spark) == before
        theirs = duck.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows_of(mine) == rows_of(theirs)
        return len(mine)

    return check
