"""Lint rules as joins, each yielding violation rows of one schema.

``(rule, path, detail, severity, fingerprint)``.  Which rules block is a
parameter of the gate, not of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellumine.functions.text import fingerprint
from vellumine.plans.durable import discard, materialise

ADVISORY, BLOCK = "advisory", "block"


def violations(found: DataFrame, rule: str, path: Column, detail: Column, severity: str) -> DataFrame:
    """Findings as violation rows; the fingerprint is over rule, path and detail."""
    path, detail = path.cast("string"), detail.cast("string")
    return found.select(F.lit(rule).alias("rule"), path.alias("path"), detail.alias("detail"), F.lit(severity).alias("severity"), fingerprint(F.lit(rule), path, detail).alias("fingerprint"))


def status_enum(notes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Notes whose (type, status) is not in allowed; a missing status is a violation too."""
    a = allowed.select(F.col("type").alias("t"), F.col("status").alias("s"))
    bad = notes.join(a, notes["type"].eqNullSafe(F.col("t")) & (notes["status"] == F.col("s")), "left_anti")
    return violations(bad, "status-enum", F.col("path"), F.concat_ws("/", F.coalesce("type", F.lit("?")), F.coalesce("status", F.lit("?"))), ADVISORY)


def catalog_check(notes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Live notes in no catalog row, and catalog rows of no note."""
    pages = notes.where(~F.col("status").eqNullSafe(F.lit("archived"))).select(F.regexp_replace("path", r"\.md$", "").alias("name"))
    links = catalog.select("link").distinct()
    both = pages.join(links, F.col("name") == F.col("link"), "full_outer").where("name is null or link is null")
    return violations(both, "catalog", F.coalesce("name", "link"), F.when(F.col("link").isNull(), "not in a catalog").otherwise("no such page"), BLOCK)


def broken_links(links: DataFrame) -> DataFrame:
    """Links that resolve to no note."""
    return violations(links.where("resolved is null").select("source", "target").distinct(), "broken-link", F.col("source"), F.col("target"), BLOCK)


def row_count_sync(router: DataFrame, catalog: DataFrame) -> DataFrame:
    """Router rows whose declared count is not that of their catalog."""
    counts = catalog.groupBy(F.col("catalog").alias("name")).agg(F.count("*").alias("n"))
    off = router.join(counts, F.col("catalog") == F.col("name"), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("declared_rows != n")
    return violations(off, "row-count", F.col("catalog"), F.concat_ws(" of ", "declared_rows", "n"), BLOCK)


def archived_in_catalog(catalog: DataFrame, notes: DataFrame) -> DataFrame:
    """Catalog rows of archived notes."""
    gone = notes.where("status = 'archived'").select(F.regexp_replace("path", r"\.md$", "").alias("name"))
    return violations(catalog.join(gone, F.col("link") == F.col("name"), "left_semi"), "archived-in-catalog", F.col("link"), F.col("catalog"), BLOCK)


def revisit_due(notes: DataFrame, as_of: Column) -> DataFrame:
    """Notes whose revisit date lies before as_of."""
    return violations(notes.where(F.col("revisit") < as_of), "revisit-due", F.col("path"), F.col("revisit"), ADVISORY)


def unsourced(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Frontmatter links of notes to raw sources that are not there."""
    named = notes.select("path", F.explode("front_links").alias("source")).where(F.startswith("source", F.lit("raw/")))
    return violations(named.join(sources.select(F.col("path").alias("source")), "source", "left_anti"), "source-binding", F.col("path"), F.col("source"), ADVISORY)


def superseded_active(notes: DataFrame, superseded: DataFrame) -> DataFrame:
    """Notes that are superseded by (source, target) yet still active."""
    active = notes.where("status = 'active'")
    return violations(active.join(superseded.select(F.col("target").alias("path")), "path", "left_semi"), "superseded-active", F.col("path"), F.col("status"), ADVISORY)


def supersedes_loops(successors: DataFrame) -> DataFrame:
    """Notes on a loop of (path, next); itself counts as a loop.  Of several next ones the smallest counts.

    Steps are doubled each round.  After as many steps as there are notes only
    loops are left, and every note of a loop is where one of them leads.  A next
    that has no row of its own ends its chain.
    """
    steps = successors.where("path is not null and next is not null").groupBy("path").agg(F.min("next").alias("next"))
    known = steps.select(F.col("path").alias("next"))
    first = steps = materialise(steps.join(known, "next", "left_semi").select("path", "next"))
    n, reach, old = steps.count(), 1, []
    while reach < n:
        far, made = steps.select(F.col("path").alias("mid"), F.col("next").alias("far")), []
        steps = materialise(steps.join(far, F.col("next") == F.col("mid")).select("path", F.col("far").alias("next")), made)
        discard(steps.sparkSession, old)
        old, reach = made, 2 * reach
    looped = first.join(steps.select(F.col("next").alias("path")).distinct(), "path", "left_semi")
    return violations(looped, "supersedes-loop", F.col("path"), F.col("next"), ADVISORY)


def drift(notes: DataFrame, catalog: DataFrame, superseded: DataFrame, successors: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """All drift detectors: the index against the pages, superseded notes, loops of them, and facts once some are registered."""
    found = catalog_check(notes, catalog).unionByName(superseded_active(notes, superseded)).unionByName(supersedes_loops(successors))
    return found if facts is None else found.unionByName(duplicate_facts(facts))


def as_report(found: DataFrame) -> DataFrame:
    """Each violation as a JSON object, a line each."""
    return found.select(F.to_json(F.struct("rule", "path", "detail", "severity")).alias("value"))


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Facts (fact_key, path) that more than one page holds: each should have one canonical page."""
    many = facts.groupBy("fact_key").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n > 1")
    return violations(many, "canonical-fact", F.col("fact_key"), F.col("n"), ADVISORY)


def changelog_sync(changelog_date: Column, index_date: Column, spark) -> DataFrame:
    """One violation if the two dates differ."""
    row = spark.range(1).select(changelog_date.alias("a"), index_date.alias("b")).where("not (a <=> b)")
    return violations(row, "changelog-sync", F.lit("CHANGELOG"), F.concat_ws(" / ", F.coalesce(F.col("a").cast("string"), F.lit("none")), F.coalesce(F.col("b").cast("string"), F.lit("none"))), ADVISORY)


def fixture_integrity(fixtures: DataFrame, expected: DataFrame) -> DataFrame:
    """Fixtures (path, text) whose SHA-256 is not the expected (path, sha256), or that are missing."""
    now = fixtures.select(F.col("path").alias("p"), F.sha2("text", 256).alias("found"))
    off = expected.join(now, F.col("path") == F.col("p"), "left").where("not (found <=> sha256)")
    return violations(off, "fixture", F.col("path"), F.coalesce("found", F.lit("missing")), BLOCK)


def beyond_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations whose fingerprint the baseline does not hold."""
    return found.join(baseline.select("fingerprint"), "fingerprint", "left_anti").select(*found.columns)


@dataclass(frozen=True)
class Gate:
    passed: bool
    blocking: int
    advisory: int


def gate(found: DataFrame) -> Gate:
    """Closed if any violation blocks."""
    row = found.agg(F.count_if(F.col("severity") == BLOCK).alias("b"), F.count_if(F.col("severity") != BLOCK).alias("a")).first()
    return Gate(row["b"] == 0, row["b"], row["a"])


def gated_report(found: DataFrame, path: str) -> Gate:
    """Writes the violations under path, as JSON lines, and closes the gate over them, in one job.

    The counts are observed as the rows pass on their way to the files, so no rule runs twice.
    """
    counts = Observation("gate")
    blocking = F.col("severity") == BLOCK
    rows = found.observe(counts, F.count_if(blocking).alias("blocking"), F.count_if(~blocking).alias("advisory"))
    rows.write.mode("overwrite").json(path)
    seen = counts.get
    return Gate(seen["blocking"] == 0, seen["blocking"], seen["advisory"])


def changed_only(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations of the paths that a write touched: warnings, which undo nothing."""
    return found.join(changed.select("path"), "path", "left_semi")
