"""Capturing sessions, promoting them, and loading context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transcripts(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(session, n_turns, n_chars, transcript)``: a line ``role: text`` per turn, in order."""
    row = F.struct(F.col(turn).alias("turn"), F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit(""))).alias("line"))
    grouped = turns.select(F.col(session).alias("session"), row.alias("x")).groupBy("session").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return grouped.select("session", F.size("rows").cast("long").alias("n_turns"), joined.alias("transcript")).select("session", "n_turns", F.length("transcript").cast("long").alias("n_chars"), "transcript")


def qualifying(turns: DataFrame, session: str = "conv_id", role: str = "role", min_turns: int = 2, needs: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Sessions with enough turns and every needed role: (session, n_turns).

    The rule is a parameter, this engine's own choice.
    """
    has = [F.max((F.col(role) == r).cast("int")) == 1 for r in needs]
    rule = F.count("*") >= min_turns
    for h in has:
        rule = rule & h
    return turns.groupBy(F.col(session).alias("session")).agg(F.count("*").alias("n_turns"), rule.alias("ok")).where("ok").drop("ok")


def pending(sessions: DataFrame, ledger: DataFrame, key: str = "session") -> DataFrame:
    """Sessions that the ledger of processed ones does not hold."""
    return sessions.join(ledger.select(key), key, "left_anti")


def promote(proposals: DataFrame, approvals: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Proposals that the owner approved; nothing else is ever applied."""
    return proposals.join(approvals.where("approved").select(key), key, "left_semi")


def recent_active(notes: DataFrame, recency: Column, limit: int = 3) -> DataFrame:
    """The most recent active projects, for the start of a session."""
    return notes.where("type = 'project' and status = 'active'").orderBy(recency.desc_nulls_last(), "path").limit(limit)


def session_context(router: DataFrame, notes: DataFrame, recency: Column, limit: int = 3) -> DataFrame:
    """What a session starts with, as ``(part, rank, name, detail)``.

    ``router``: categories and their catalogs, by name; ``recent``: the most
    recent active projects, path and title; ``active-now``: how many notes of
    each type are active.  The last is this engine's own reading.
    """
    def ranked(rows: DataFrame, part: str, *order: Column) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), F.col("name").cast("string").alias("name"), F.col("detail").cast("string").alias("detail"))

    categories = router.select(F.col("category").alias("name"), F.col("catalog").alias("detail"))
    recent = recent_active(notes.withColumn("_recency", recency), F.col("_recency"), limit).select(F.col("path").alias("name"), F.col("title").alias("detail"), "_recency")
    now = notes.where("status = 'active'").groupBy(F.col("type").alias("name")).agg(F.count("*").alias("detail"))
    parts = [ranked(categories, "router", F.col("name"), F.col("detail")), ranked(recent, "recent", F.col("_recency").desc_nulls_last(), F.col("name")), ranked(now, "active-now", F.col("name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def route(router: DataFrame, catalog: DataFrame, notes: DataFrame, category: str) -> DataFrame:
    """From a category to its catalog's rows to their pages: two selective joins."""
    rows = router.where(F.col("category") == category).select("catalog").join(catalog, "catalog")
    return rows.join(notes.withColumn("link", F.regexp_replace("path", r"\.md$", "")), "link")


def refresh_catalog(catalog: DataFrame, changed: DataFrame) -> DataFrame:
    """The catalog (link, summary, ...) after changed notes (link, summary, status): archived rows go, others are set.

    Rows of notes that did not change stay as they are.
    """
    kept = catalog.join(changed.select("link"), "link", "left_anti")
    columns = catalog.columns
    new = changed.where(~F.col("status").eqNullSafe(F.lit("archived")))
    return kept.select(*columns).unionByName(new.select(*[c for c in columns if c in new.columns]), allowMissingColumns=True)


def log_lines(events: DataFrame) -> DataFrame:
    """Activity log lines of (event_date, event_type, text), for an append to a text sink."""
    day = F.date_format("event_date", "yyyy-MM-dd")
    return events.select(F.concat(F.lit("## ["), day, F.lit("] "), F.col("event_type"), F.lit(" | "), F.regexp_replace("text", r"\s+", " ")).alias("value"))
