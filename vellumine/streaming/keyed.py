"""Keyed state: what a crawl knows of each URL, and sessions that end by themselves.

State stands in Spark's state store, a partition of keys in each task, and goes
to the query's checkpoint folder.  A batch reads and writes the keys that occur
in it and those whose timer is due, never all that was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# What is said of a URL, and what is answered.
FOUND, DONE, FAILED = "found", "done", "failed"
FETCH, FINISHED, GAVE_UP = "fetch", "finished", "gave-up"

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "key string, action string, tries int, at_ms long"


@dataclass(frozen=True)
class Policy:
    """When a URL is asked for again, and when it is forgotten; milliseconds of event time."""

    #: A fetch without an answer for so long is made again.
    answer_ms: int = 10 * 60_000
    #: A failed one is made again after so long, twice as long each time.
    retry_ms: int = 60_000
    most_tries: int = 3
    #: A URL of which nothing is heard for so long is as one never seen.
    forget_ms: int = 30 * 86_400_000


class CrawlState(StatefulProcessor):
    """One URL: is it asked for, done, or given up, and what is due next.

    A URL has one timer.  While it is open, it is for the next try; once it is
    closed, for being forgotten, so that state is bounded by what was heard of in
    ``forget_ms``.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, tries int, heard_ms long, due_ms long")

    def _set(self, state: str, tries: int, heard: int, due: int, before: tuple | None) -> None:
        if before is not None and before[3] != due:
            self.handle.deleteTimer(before[3])
        if before is None or before[3] != due:
            self.handle.registerTimer(due)
        self.known.update((state, tries, heard, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        policy = self.policy
        before = tuple(self.known.get()) if self.known.exists() else None
        now = before
        out = []
        # the rows of a batch in order of time; of one moment, what was found first
        rank = {FOUND: 0, FAILED: 1, DONE: 2}
        for at, status in sorted(((int(r.at_ms), r.status) for r in rows if r.at_ms is not None and r.status in rank), key=lambda x: (x[0], rank[x[1]])):
            if now is None and status in (FOUND, FAILED):
                now = (FETCH, 1, at, at + policy.answer_ms)
                out.append(Row(key=key[0], action=FETCH, tries=1, at_ms=at))
            elif status == DONE and (now is None or now[0] in (FETCH, FAILED)):
                tries = now[1] if now else 0
                now = (DONE, tries, at, at + policy.forget_ms)
                out.append(Row(key=key[0], action=FINISHED, tries=tries, at_ms=at))
            elif status == FAILED and now is not None and now[0] == FETCH:
                if now[1] >= policy.most_tries:
                    now = (GAVE_UP, now[1], at, at + policy.forget_ms)
                    out.append(Row(key=key[0], action=GAVE_UP, tries=now[1], at_ms=at))
                else:
                    now = (FAILED, now[1], at, at + policy.retry_ms * 2 ** (now[1] - 1))
            elif now is not None and now[0] in (DONE, GAVE_UP):
                now = (now[0], now[1], max(now[2], at), max(now[2], at) + policy.forget_ms)
        if now is not None and now != before:
            self._set(*now, before)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.known.exists():
            return iter(())
        state, tries, heard, due = self.known.get()
        if due != at:
            return iter(())
        if state in (DONE, GAVE_UP):
            self.known.clear()
            return iter(())
        if tries >= self.policy.most_tries:
            self.known.update((GAVE_UP, tries, heard, at + self.policy.forget_ms))
            self.handle.registerTimer(at + self.policy.forget_ms)
            return iter((Row(key=key[0], action=GAVE_UP, tries=tries, at_ms=at),))
        self.known.update((FETCH, tries + 1, at, at + self.policy.answer_ms))
        self.handle.registerTimer(at + self.policy.answer_ms)
        return iter((Row(key=key[0], action=FETCH, tries=tries + 1, at_ms=at),))

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state and its timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def crawl_actions(news: DataFrame, policy: Policy = Policy(), late: str = "10 minutes") -> DataFrame:
    """``(key, action, tries, at_ms)``: what a crawl is to do, from news (key, status, ts) of its URLs.

    ``found`` asks for a URL once; ``failed`` asks again after a while, longer
    each time, and gives up after ``most_tries``; no answer is as a failure;
    ``done`` closes it.  Time is the news' own, with a watermark of ``late``, so
    a restart goes on where the checkpoint stands and says the same.  Null keys,
    times and other statuses say nothing.
    """
    use_keyed_state(news.sparkSession)
    timed = news.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(F.col("key").cast("string").alias("key"), "status", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("key").transformWithState(CrawlState(policy), ANSWER, "append", "eventTime")


def ended_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes", measures: dict[str, Column] | None = None) -> DataFrame:
    """``(key, started, ended, n_events, ...)``: a session per run of events less than ``gap`` apart.

    In a stream a session is given once, when the watermark has passed its end,
    and an event that comes after that is dropped; in a batch all sessions are
    given.  ``ended`` is the last event's time plus the gap.  Null keys and times
    are in no session.
    """
    measures = {"n_events": F.count("*"), **(measures or {})}
    timed = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    found = timed.groupBy(key, F.session_window(time, gap).alias("_window")).agg(*[value.alias(name) for name, value in measures.items()])
    return found.select(key, F.col("_window.start").alias("started"), F.col("_window.end").alias("ended"), *measures)
