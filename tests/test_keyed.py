from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from vellumine.streaming import capture as streaming
from vellumine.streaming import keyed as K

SCHEMA = "key string, status string, ts timestamp"
START = datetime(2024, 1, 1)
MINUTE = 60_000


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, tmp_path, batches, policy):
    """Each batch as a file, and a query that starts anew for each: answers as (key, action, tries, minute)."""
    out = []

    def keep(rows, number):
        out.extend((r.key, r.action, r.tries, (r.at_ms / 1000 - START.timestamp()) / 60) for r in rows.collect())

    for rows in batches:
        spark.createDataFrame([(k, s, at(m) if m is not None else None) for k, s, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.file_stream(spark, str(tmp_path / "in"), SCHEMA)
        query = K.crawl_actions(stream, policy, late="1 minute").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    return out


@pytest.fixture
def utc(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_crawl_over_restarts(spark, tmp_path, utc):
    policy = K.Policy(answer_ms=10 * MINUTE, retry_ms=2 * MINUTE, most_tries=2, forget_ms=60 * MINUTE)
    said = run(
        spark, tmp_path,
        [
            [("a", "found", 0), ("b", "found", 0), ("c", "found", 1), ("a", "found", 1), (None, "found", 0), ("x", "odd", 0), ("y", "found", None)],
            [("a", "done", 2), ("a", "found", 3), ("b", "failed", 3)],
            [("tick", "done", 30)],
            [("tick", "done", 60)],
            [("a", "found", 61), ("tick", "done", 200)],
            [("a", "found", 201)],
        ],
        policy,
    )
    mine = [x for x in said if x[0] != "tick"]
    assert sorted(mine[:3]) == [("a", "fetch", 1, 0.0), ("b", "fetch", 1, 0.0), ("c", "fetch", 1, 1.0)]
    assert mine[3] == ("a", "finished", 1, 2.0)
    # b failed at 3 and is asked again at 5; nothing is heard of it, so it is given up; c likewise
    assert [x for x in mine if x[0] == "b"][1:] == [("b", "fetch", 2, 5.0), ("b", "gave-up", 2, 15.0)]
    assert [x for x in mine if x[0] == "c"][1:] == [("c", "fetch", 2, 11.0), ("c", "gave-up", 2, 21.0)]
    # a was heard of at 61, so it is forgotten at 121, and then found anew
    assert [x for x in mine if x[0] == "a"][2:] == [("a", "fetch", 1, 201.0)]


def test_state_is_bounded(spark, tmp_path, utc):
    policy = K.Policy(answer_ms=MINUTE, retry_ms=MINUTE, most_tries=1, forget_ms=2 * MINUTE)
    batches = [[(f"k{n}-{i}", "found", 20 * n) for i in range(50)] for n in range(4)]
    said = run(spark, tmp_path, batches, policy)
    assert sum(x[1] == "fetch" for x in said) == 200
    held = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "ckpt")).count()
    assert held <= 100


def test_sessions_end_by_themselves(spark, tmp_path):
    schema = "user long, ts timestamp"
    batches = [
        [(1, 0), (1, 10), (2, 5), (None, 5)],
        [(1, 25), (2, 90)],
        # of user 1, too late, and of user 2, in its open session
        [(1, 12), (2, 100), (3, 200)],
        [(3, 300)],
    ]
    out = []
    for rows in batches:
        spark.createDataFrame([(u, at(m)) for u, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.file_stream(spark, str(tmp_path / "in"), schema)
        found = K.ended_sessions(stream, "user", "ts", "20 minutes", "10 minutes")
        query = found.writeStream.foreachBatch(lambda rows, n: out.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(out) == [(1, at(0), at(45), 3), (2, at(5), at(25), 1), (2, at(90), at(120), 2), (3, at(200), at(220), 1)]
    # a batch gives the open ones too, and knows no late events
    whole = K.ended_sessions(spark.read.schema(schema).parquet(str(tmp_path / "in")), "user", "ts", "20 minutes").collect()
    assert len(whole) == 5 and {tuple(r)[:4] for r in whole if r.user == 1} == {(1, at(0), at(45), 4)}
