"""Connected components of an undirected graph, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.plans.durable import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every end of an edge with the smallest node it can reach.

    Returns ``(node, component)``.  Self-loops give a node its own label;
    edges with a null end are no edges; repeated edges change nothing; an
    empty table gives an empty one.

    Each round, every node picks its smallest neighbour, picks are followed to
    their roots, and the graph is contracted to the roots.  Every node that is
    no local minimum disappears, so the edges shrink geometrically and the
    number of rounds is logarithmic.  A round writes its picks and what is left
    of the graph; the picks of all rounds are put together at the end, from the
    last and smallest on, so no round touches the nodes that are done with.
    Degrees are reduced by a partial aggregate before the shuffle, so hubs do not
    land in one task; lost executors cost one write at most.
    """
    kind = edges.schema[a].dataType
    spark = edges.sparkSession
    kept: list[str] = []
    ends = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a is not null and b is not null")
    every = materialise(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), kept)
    live, old, rounds = every.where("a != b"), [], []
    while not live.isEmpty():
        picks = _roots(live, kept)
        left, right = (picks.select(F.col("a").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        joined = live.join(left, "a").join(right, "b").where("up_a != up_b")
        made: list[str] = []
        live = materialise(joined.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), made)
        discard(spark, old)
        old = made
        rounds.append(picks)
    nodes = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
    found = None
    for picks in reversed(rounds):
        if found is not None:
            above = found.select(F.col("a").alias("mid"), F.col("up").alias("top"))
            picks = materialise(picks.join(above, F.col("up") == F.col("mid"), "left").select("a", F.coalesce("top", "up").alias("up")), kept)
        found = picks
    named = nodes.withColumn("component", F.col("node")) if found is None else nodes.join(found, F.col("node") == F.col("a"), "left").select("node", F.coalesce("up", "node").alias("component"))
    result = materialise(named)
    discard(spark, kept + old)
    return result


def _roots(live: DataFrame, kept: list[str]) -> DataFrame:
    """``(a, up)``: each node's smallest neighbour, that one's, and so on, up to one that has none smaller."""
    spark = live.sparkSession
    old: list[str] = []
    both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")), old)
    while True:
        # two steps at once, each as long as all before
        once, made = _doubled(step.select("a", "up", F.col("up").alias("was"))), []
        step = materialise(_doubled(once).select("a", "up", (F.col("up") != F.col("was")).alias("moved")), made)
        discard(spark, old)
        if step.where("moved").isEmpty():
            kept += made
            return step.select("a", "up")
        step, old = step.select("a", "up"), made


def _doubled(step: DataFrame) -> DataFrame:
    over = step.select(F.col("a").alias("mid"), F.col("up").alias("top"))
    return step.join(over, F.col("up") == F.col("mid")).select("a", F.col("top").alias("up"), "was")
