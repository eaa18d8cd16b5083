"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.plans.durable import materialise

#: The most frequent keys, which are broadcast; a row each.
FREQUENT = 2_000


def meet(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner", kept: list[str] | None = None) -> DataFrame:
    """Joins rows with keyed, a row per key, whose ``weight`` says how many rows have the key.

    Rows of the most frequent keys meet a broadcast where they stand.  Any other
    key holds at most one in ``FREQUENT`` of the rows, so its rows are shuffled.
    ``how`` is inner or left; null keys meet nothing.  ``kept`` collects the path
    of the table of frequent keys, which the result reads.
    """
    often = materialise(keyed.orderBy(F.desc(weight), *on).limit(FREQUENT), kept)
    keys = F.broadcast(often.select(*on))
    rest = rows.join(keys, on, "left_anti").join(keyed.join(keys, on, "left_anti"), on, how)
    return rows.join(F.broadcast(often), on).unionByName(rest)
