"""Queries of the vault operators over the driver's tables, with their oracles.

The driver's tables hold no vault, so tables stand in for its parts: documents
for notes, labels for statuses (toxic is terminal), conversations for sessions,
pages for pages, hrefs for links, orders for notes with a deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import plain
from vellumine.operators import capture, links, lint, pages, search
from vellumine.operators.components import connected_components
from vellumine.operators.gram_index import GramIndex
from vellumine.plans.durable import shared_dir
from vellumine.sources import vault
from vellumine.sources.tables import table
from vellumine.streaming.capture import windowed_counts
from vellumine.streaming.keyed import ended_sessions

QUERY = "the EN src3 42 tion"
_HREF = "regexp_extract_all(coalesce(html, ''), '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


def _found(spark: SparkSession, sf_dir: str, limit: int, explain: bool = False) -> DataFrame:
    flags = search.freshness(table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1)
    return search.search(table(spark, sf_dir, "documents"), QUERY, limit, explain=explain, flags=flags)


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 20)


def search_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 50, explain=True).select("doc_id", "rank", "reasons")


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.with_freshness(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1)
    return search.matches(docs, QUERY)


#: A term that few documents hold.
RARE = "copyright"


def _index(spark: SparkSession, sf_dir: str) -> GramIndex:
    """Documents in two additions of 50 blocks."""
    index, docs = GramIndex(spark, shared_dir(spark)), table(spark, sf_dir, "documents")
    for addition in (0, 1):
        index.add(docs.where(F.col("doc_id") % 2 == addition), addition, F.col("doc_id") % 100)
    return index


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = search.freshness(table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1)
    return _index(spark, sf_dir).matches(f"{RARE} src7 11", flags)


def search_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three queries read of all there is: a rare term, an identifier that is one, and a term too short to prune."""
    index = _index(spark, sf_dir)
    reports = [index.report(query).select(F.lit(query).alias("query"), "*") for query in (RARE, "17qq", "zz")]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.as_json(_found(spark, sf_dir, 20).select("doc_id", "rank"))


def search_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.originals(_found(spark, sf_dir, 20), table(spark, sf_dir, "documents")).select("rank", "doc_id", "lang", "source", "n_chars", "text")


def search_originals_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries by point reads."""
    return _index(spark, sf_dir).originals(_found(spark, sf_dir, 20)).select("rank", "doc_id", "lang", "source", "n_chars", "text")


def search_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of every way that a search can end."""

    def docs():
        return table(spark, sf_dir, "documents")

    def broken():
        raise RuntimeError("no reader")

    cases = {
        "found": (docs, QUERY, 20, None), "nothing found": (docs, "qqzzqq", 20, None), "empty corpus": (lambda: docs().where("false"), QUERY, 20, None), "filters leave nothing": (docs, QUERY, 20, F.col("lang") == "xx"),
        "no query": (docs, " ", 20, None), "bad limit": (docs, QUERY, 0, None), "unreadable": (lambda: spark.read.parquet(f"{sf_dir}/no_such_corpus"), QUERY, 20, None), "internal": (broken, QUERY, 20, None),
    }
    ended = [(name, search.run_search(load, query, limit, filters=kept)) for name, (load, query, limit, kept) in cases.items()]
    return spark.createDataFrame([(name, e.mode, e.reason, e.exit_code, len(e.results)) for name, e in ended], "name string, mode string, reason string, exit_code int, n_results long")


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(table(spark, sf_dir, "pages"))


def link_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.in_degree(_page_links(spark, sf_dir))


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(path.alias("path")).distinct()


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.resolve(_page_links(spark, sf_dir), _page_paths(spark, sf_dir)).withColumn("origin", F.lit("body"))


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.audit(_resolved(spark, sf_dir))


def link_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.broken_links(_resolved(spark, sf_dir)).select("rule", "path", "detail", "severity")


def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _page_links(spark, sf_dir).select(F.concat(F.lit("page:"), F.col("source").cast("string")).alias("a"), F.concat(F.lit("to:"), F.col("target")).alias("b"))
    return connected_components(edges)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("path"), pages.page_title(F.col("html")).alias("title"))
    found = _page_links(spark, sf_dir).select(F.concat(F.lit("page:"), F.col("source").cast("string")).alias("source"), F.concat(F.lit("to:"), F.col("target")).alias("target"))
    return p.unionByName(found.select(F.col("target").alias("path"), F.col("target").alias("title")).distinct()), found.distinct()


def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = _graph(spark, sf_dir)
    return links.neighbourhood(vertices, edges, "thble", hops=2)


def link_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    edges = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source"), (F.col("doc_id") - F.col("doc_id") % 7).cast("string").alias("target"))
    known = edges.join(docs.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target").where("source != target")
    return links.connectivity(docs, known)


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages link to notes by names that are mostly wrong by a digit or two."""
    names = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/n"), (F.col("doc_id") * 37 % 10007).cast("string"), F.lit(".md")).alias("name"))
    broken = table(spark, sf_dir, "pages").select(F.concat(F.lit("SRC"), (F.col("page_id") % 20).cast("string"), F.lit("/n"), (F.col("page_id") * 91 % 10007).cast("string")).alias("target"))
    return links.link_candidates(broken, names, 1)


def unlinked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    title = pages.page_title(F.col("html"))
    titles = table(spark, sf_dir, "pages").select(title.alias("name"), title.alias("title")).where("title is not null")
    return links.unlinked_mentions(docs, titles)


def lint_status_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").cast("string").alias("type"), F.col("toxic").cast("string").alias("status"))
    allowed = spark.sql("select * from values ('0', '0'), ('1', '0'), ('1', '1') as t(type, status)")
    return lint.status_enum(notes, allowed)


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    router = docs.select(F.col("source").alias("catalog")).distinct().withColumn("declared_rows", F.when(F.endswith("catalog", F.lit("7")), 40).otherwise(50).cast("long"))
    return router, docs.select(F.col("source").alias("catalog"), F.col("doc_id").alias("link"))


def lint_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.row_count_sync(*_declared(spark, sf_dir))


def lint_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("active").alias("status"))
    catalog = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).cast("string").alias("link"))
    return lint.catalog_check(notes, catalog).select("path", "detail")


def lint_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"))
    catalog = table(spark, sf_dir, "documents").select(F.col("source").alias("catalog"), F.col("doc_id").cast("string").alias("link"))
    return lint.archived_in_catalog(catalog, notes).select("path", "detail")


def lint_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("date").alias("revisit"))
    return lint.revisit_due(notes, F.lit("1996-01-01").cast("date")).select("rule", "path", "detail", "severity")


def lint_beyond_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint_status_enum(spark, sf_dir)
    return lint.beyond_baseline(found, found.where(F.col("path").cast("long") % 3 == 0)).select("path", "fingerprint")


def lint_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write touched the notes whose ids are pages too."""
    changed = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"))
    return lint.changed_only(lint_status_enum(spark, sf_dir), changed).select("path", "detail")


def lint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "conversations").select(F.concat(F.lit("raw/"), F.col("conv_id").cast("string")).alias("path")).distinct()
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array(F.concat(F.lit("raw/"), F.col("doc_id").cast("string")), F.lit("people/ann")).alias("front_links"))
    return lint.unsourced(named, sources)


def lint_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected hashes are those of texts without their last character, where the quality is 0."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality")
    kept = F.when(F.col("quality") == 0, F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    expected = docs.join(quality, "path").select("path", F.sha2(kept, 256).alias("sha256")).union(spark.sql("select '-1', 'none'"))
    return lint.fixture_integrity(docs, expected).select("path", "detail", "severity")


def lint_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index dated by the last event, a changelog by the first; the dates are read from their texts."""
    events = table(spark, sf_dir, "events").agg(*[F.date_format(f("ts"), "yyyy-MM-dd").alias(n) for f, n in ((F.max, "last"), (F.min, "first"))])
    index = events.select(F.lit("index").alias("path"), F.concat(F.lit("# Index\n\nLast updated: "), F.col("last"), F.lit(" - all of it\n")).alias("text"))
    log = events.select(F.lit("CHANGELOG").alias("path"), F.concat(F.lit("# CHANGELOG\n\n## "), F.col("first"), F.lit("\n- an entry\n")).alias("text"))
    dates = {r["path"]: r["updated"] for r in vault.parse_updated(index.union(log)).collect()}
    return lint.changelog_sync(F.lit(dates["CHANGELOG"]).cast("date"), F.lit(dates["index"]).cast("date"), spark).select("rule", "path", "detail", "severity")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    notes = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "en", "active").otherwise("closed").alias("status"))
    catalog = labels.select((F.col("doc_id") * 2).cast("string").alias("link"))
    superseded = labels.where("quality = 1").select(F.lit("x").alias("source"), F.col("doc_id").cast("string").alias("target"))
    successors = docs.select(F.col("doc_id").cast("string").alias("path"), ((F.col("doc_id") * F.col("doc_id") + 1) % 1009).cast("string").alias("next"))
    return lint.drift(notes, catalog, superseded, successors)


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.as_report(_drift(spark, sf_dir))


def lint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all rules whose findings have fingerprints here."""
    found = lint_status_enum(spark, sf_dir).unionByName(lint_row_count(spark, sf_dir)).unionByName(lint_sources(spark, sf_dir)).unionByName(_drift(spark, sf_dir))
    gate = lint.gated_report(found, shared_dir(spark))
    return spark.createDataFrame([(gate.passed, gate.blocking, gate.advisory)], "passed boolean, blocking long, advisory long")


def lint_canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("fact_key"), F.col("doc_id").cast("string").alias("path"))
    return lint.duplicate_facts(facts).select(F.col("path").alias("fact_key"), F.col("detail").alias("n_pages"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.transcripts(table(spark, sf_dir, "conversations"))


def qualifying_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.qualifying(table(spark, sf_dir, "conversations"), min_turns=4)


def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = capture.qualifying(table(spark, sf_dir, "conversations"))
    return capture.pending(sessions, sessions.where("session % 3 = 0"))


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("proposal_id"), "source")
    approvals = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("proposal_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("approved"))
    return capture.promote(proposals, approvals)


def recent_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit("project").alias("type"), F.when(F.col("lang") == "en", "active").otherwise("closed").alias("status"), "n_chars")
    return capture.recent_active(notes, F.col("n_chars")).select("path", "n_chars")


def catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("link"), F.col("lang").alias("summary"))
    changed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("link"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"), F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"))
    return capture.refresh_catalog(catalog, changed)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown notes (path, text), with frontmatter and links."""
    doc_id = F.col("doc_id").cast("string")
    status = F.element_at(F.array(F.lit("active"), F.lit("closed"), F.lit("archived")), (F.col("doc_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("lang") == "en", "project").otherwise("insight")
    front = F.concat(F.lit("---\ntitle: Doc "), doc_id, F.lit("\ntype: "), kind, F.lit("\nstatus: "), status, F.lit("\nrelated: [["), (F.col("doc_id") + 7).cast("string"), F.lit("]]\n---\n# Heading\n"))
    links = F.concat(F.lit("See [["), F.col("source"), F.lit("/"), (F.col("doc_id") + 1).cast("string"), F.lit("#part]] and [["), (F.col("doc_id") * 2).cast("string"), F.lit("|that]].\n"))
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), doc_id, F.lit(".md")).alias("path"), F.concat(front, links, F.coalesce("text", F.lit(""))).alias("text"))


def parsed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.parse_notes(_files(spark, sf_dir)).select("path", "title", "type", "status", F.size("body_links").cast("long").alias("n_body"), F.element_at("front_links", 1).alias("related"), F.length("body").cast("long").alias("n_chars"))


def _note_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = vault.parse_notes(_files(spark, sf_dir))
    return notes, links.resolve(links.note_links(notes), notes)


def link_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.audit(_note_links(spark, sf_dir)[1])


def graph_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph is built, written to a cache, and asked from there."""
    notes, found = _note_links(spark, sf_dir)
    cache = shared_dir(spark)
    links.build_graph(found, notes, cache)
    return links.neighbourhood(*links.read_graph(spark, cache), "doc 11", hops=1)


def _router_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.col("source"), F.lit(" | "), F.col("n").cast("string"), F.lit(" | [[index-"), F.col("source"), F.lit("]] | documents of "), F.col("source"), F.lit(" |"))
    lines = counts.select(line.alias("line")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    return lines.select(F.lit("index.md").alias("path"), F.concat(F.lit("# Index\n\n| category | rows | catalog | text |\n|---|---|---|---|\n"), F.col("lines"), F.lit("\n\n## Use\n")).alias("text"))


def parsed_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.parse_router(_router_file(spark, sf_dir))


def parsed_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog file for each document, with a placeholder beside its row."""
    doc_id = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Catalog\n\n> rows are | [[path/name]] | text |\n\n## Live\n\n| page | summary |\n|---|---|\n| [["), F.col("source"), F.lit("/"), doc_id, F.lit("]] | "), F.col("lang"), F.lit(" — of "), F.col("n_chars").cast("string"), F.lit(" |\n\n## Old\n\n| _none yet_ | |\n"))
    return vault.parse_research(table(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/index-"), doc_id, F.lit(".md")).alias("path"), text.alias("text")))


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit("# Activity Log\n\n> one line each: `## [YYYY-MM-DD] type | text`\n## ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), F.col("event_type"), F.lit(" | event "), F.col("event_id").cast("string"), F.lit("  \n"))
    return vault.parse_log(events.select(F.lit("log.md").alias("path"), text.alias("text"))).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = vault.parse_notes(_files(spark, sf_dir))
    return capture.session_context(parsed_router(spark, sf_dir), notes, F.length("body"))


def category_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "documents").select(F.concat(F.lit("index-"), F.col("source")).alias("catalog"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("link"))
    return capture.route(parsed_router(spark, sf_dir), catalog, vault.parse_notes(_files(spark, sf_dir)), "src3").select("catalog", "path", "title", "status")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("event_date"), "event_type", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text"))
    return capture.log_lines(events)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ended_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes", measures={"most": F.max("value")})
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "ended")], "n_events", "most")


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by any field of their frontmatter."""
    notes = vault.parse_notes(_files(spark, sf_dir)).withColumn("fields", vault.front_fields(F.col("front")))
    return search.matches(notes, "archived PROJECT tion", search.Fields("path", "body", (), fields="fields")).drop("stale")


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_text(table(spark, sf_dir, "pages"))


def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_content(table(spark, sf_dir, "pages")).drop("markdown")


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = spark.sql("select * from values ('com'), ('org'), ('example.com'), ('*.example.org'), ('!tionble.example.org'), ('nowhere') as t(rule)")
    return pages.registrable_domains(table(spark, sf_dir, "pages").select("page_id", "url"), suffixes).drop("url")


FIELDS = {"heading": r"(?is)<h1[^>]*>(.*?)</h1", "language": r"""(?is)<html[^>]*\blang="([^"]*)\"""", "first_link": r"""(?is)\bhref="([^"]*)\""""}


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.collect_fields(table(spark, sf_dir, "pages"), FIELDS)


def page_render_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.render_status(table(spark, sf_dir, "pages"), min_chars=600)


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.as_markdown(table(spark, sf_dir, "pages").select("page_id", "url"))


def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.pending_pages(p, p.where("page_id % 4 = 0"))


def blocked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.sql("select * from values ('License'), ('copyright'), ('ndwhst') as t(term)")
    return pages.without_blocked(table(spark, sf_dir, "documents"), terms, "text").select("doc_id")


def blocked_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any run of three words of a benchmark item: a list of over a thousand terms."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " "))
    terms = table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") >= 3).select(F.explode(runs).alias("term"))
    return pages.without_blocked(table(spark, sf_dir, "documents"), terms, "text").select("doc_id")


def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per word: what an identifier or anchor word is chosen by."""
    words = F.explode(F.array_distinct(F.split(F.trim(plain(F.lower("text"))), " "))).alias("word")
    return table(spark, sf_dir, "documents").select(words).where("word != ''").groupBy("word").agg(F.count("*").alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (
        search_topk, search_explain, search_matches, search_indexed, search_index_report, search_fields, search_json, search_originals, search_originals_indexed, search_envelopes,
        link_indegree, link_audit, link_unresolved, link_candidates, link_components, link_connectivity, graph_neighbourhood, graph_cached, link_origins, unlinked_mentions,
        lint_status_enum, lint_row_count, lint_catalog, lint_archived, lint_revisit, lint_beyond_baseline, lint_gate, lint_canonical_facts, lint_changed, lint_sources, lint_fixtures, lint_changelog, drift_report,
        parsed_notes, parsed_router, parsed_research, parsed_log, session_context, category_pages,
        transcripts, qualifying_sessions, pending_sessions, promoted, recent_active, catalog_refresh, log_lines, events_hourly, session_ends,
        page_title, page_text, page_content, page_domains, page_fields, page_render_status, page_markdown, pending_pages, blocked_terms, blocked_phrases, word_frequency,
    )
}

_TERMS = list(search.terms_of(QUERY))
_HITS = " + ".join(f"cast(contains(lower(text), '{t}') as bigint)" for t in _TERMS)
_META = " + ".join(f"cast(lower({m}) = '{t}' as bigint)" for t in _TERMS for m in ("lang", "source"))
_FOUND = f"""
with status as (select doc_id, max(toxic) = 1 as stale from labels group by doc_id),
scored as (
  select d.doc_id, cast(d.doc_id as varchar) in ({", ".join(f"'{t}'" for t in _TERMS)}) as exact, coalesce(stale, false) as stale,
    {_HITS} as text_hits, {_META} as meta_hits, d.lang, d.source, d.n_chars, d.text
  from documents d left join status s on s.doc_id = d.doc_id
), found as (select * from scored where exact or text_hits > 0 or meta_hits > 0),
ranked as (select *, row_number() over (order by exact desc, stale, text_hits desc, meta_hits desc, doc_id) as rank from found)
"""
_LINKS = f"with links as (select page_id as source, unnest({_HREF}) as target from pages)"
_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')), '')"
_STRIPPED = "coalesce(html, '')"
for _tag in ("script", "style", "noscript", "template"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_STRIPPED = f"regexp_replace(regexp_replace({_STRIPPED}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_name}', '{_char}')"
_STRIPPED = f"trim(regexp_replace({_STRIPPED}, '\\s+', ' ', 'g'))"
_RESOLVED = f"""{_LINKS}, names as (select distinct regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages),
keys as (select path, regexp_replace(lower(trim(path)), '\\.md$', '') as name from names),
parts as (select path, string_split(name, '/') as seg from keys),
ends as (select path, array_to_string(seg[i:], '/') as key from parts, unnest(range(1, len(seg) + 1)) as t(i)),
best as (select key, first(path order by length(path), path) as resolved from ends group by key),
resolved as (select links.*, resolved from links left join best on regexp_replace(lower(trim(target)), '\\.md$', '') = key)"""
_ENUM = "select 'status-enum' as rule, cast(doc_id as varchar) as path, quality || '/' || toxic as detail, 'advisory' as severity from labels where quality = 0 and toxic = 1"
_COUNTS = """select 'row-count' as rule, source as path, declared || ' of ' || n as detail, 'block' as severity
  from (select source, case when suffix(source, '7') then 40 else 50 end as declared, count(*) as n from documents group by 1, 2) where declared <> n"""
_PRINTED = "select *, sha256(rule || chr(31) || path || chr(31) || detail) as fingerprint from"
_SOURCES = """select 'source-binding' as rule, cast(doc_id as varchar) as path, 'raw/' || doc_id as detail, 'advisory' as severity
  from documents where doc_id not in (select conv_id from conversations where conv_id is not null)"""
_CATALOG = """select cast(coalesce(d.doc_id, l.link) as varchar) as path, case when l.link is null then 'not in a catalog' else 'no such page' end as detail
  from documents d full join (select distinct doc_id * 2 as link from labels) l on d.doc_id = l.link where d.doc_id is null or l.link is null"""
_DRIFT = f"""with recursive steps as (select doc_id as a, (doc_id * doc_id + 1) % 1009 as b from documents where (doc_id * doc_id + 1) % 1009 in (select doc_id from documents)),
walk as (select a, b from steps union select walk.a, steps.b from walk join steps on walk.b = steps.a),
found as (
  select 'catalog' as rule, path, detail, 'block' as severity from ({_CATALOG})
  union all select 'superseded-active', cast(doc_id as varchar), 'active', 'advisory' from documents where lang = 'en' and doc_id in (select doc_id from labels where quality = 1)
  union all select 'supersedes-loop', cast(a as varchar), cast((a * a + 1) % 1009 as varchar), 'advisory' from walk where a = b
)"""
_NOTES = """with notes as (select doc_id, source, source || '/' || doc_id || '.md' as path, 'Doc ' || doc_id as title, case when lang = 'en' then 'project' else 'insight' end as type,
  case doc_id % 3 when 0 then 'active' when 1 then 'closed' else 'archived' end as status,
  '# Heading' || chr(10) || 'See [[' || source || '/' || (doc_id + 1) || '#part]] and [[' || doc_id * 2 || '|that]].' || chr(10) || coalesce(text, '') as body from documents)"""
_LINKED = f"""{_NOTES}, written as (
  select path, 'body' as origin, source || '/' || (doc_id + 1) as target from notes union all select path, 'body', cast(doc_id * 2 as varchar) from notes
  union all select path, 'frontmatter', cast(doc_id + 7 as varchar) from notes
), names as (select path, lower(source) || '/' || doc_id as key from notes union all select path, cast(doc_id as varchar) from notes),
best as (select key, first(path order by length(path), path) as resolved from names group by key),
found as (select written.*, resolved from written left join best on lower(target) = key)"""
_REACH = """, both_ways as (select a, b from edges union select b, a from edges),
reach as (select a, a as b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)"""
_FIELD = {"heading": "(?is)<h1[^>]*>(.*?)</h1", "language": '(?is)<html[^>]*\\blang="([^"]*)"', "first_link": '(?is)\\bhref="([^"]*)"'}

ORACLE_SQL = {
    "search_topk": f"{_FOUND} select doc_id, exact, stale, text_hits, meta_hits, rank from ranked where rank <= 20",
    "search_explain": f"""{_FOUND} select doc_id, rank, concat_ws(',', case when exact then 'identifier' end, case when text_hits > 0 then 'text:' || text_hits end,
      case when meta_hits > 0 then 'metadata:' || meta_hits end, case when stale then 'terminal-status' end) as reasons from ranked where rank <= 50""",
    "search_matches": f"{_FOUND} select doc_id, exact, stale, text_hits, meta_hits from found",
    "search_indexed": f"""with status as (select doc_id, max(toxic) = 1 as stale from labels group by doc_id),
      scored as (select d.doc_id, cast(d.doc_id as varchar) = '11' as exact, coalesce(stale, false) as stale,
        cast(contains(lower(text), '{RARE}') as bigint) + cast(contains(lower(text), 'src7') as bigint) + cast(contains(lower(text), '11') as bigint) as text_hits, cast(lower(source) = 'src7' as bigint) as meta_hits
        from documents d left join status s on s.doc_id = d.doc_id)
      select * from scored where exact or text_hits > 0 or meta_hits > 0""",
    "search_index_report": f"""with blocks as (select doc_id % 2 as addition, doc_id % 100 as block, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as n_bytes,
        {" and ".join(f"bool_or(contains(lower(text), '{RARE[i : i + 3]}'))" for i in range(len(RARE) - 2))} as rare,
        bool_or(contains(lower(text), '17q')) and bool_or(contains(lower(text), '7qq')) as odd from documents group by 1, 2),
      picks as (select '{RARE}' as query, rare as picked, n_bytes from blocks union all select '17qq', odd, n_bytes from blocks union all select 'zz', true, n_bytes from blocks)
      select query, count(*) as n_blocks, cast(sum(n_bytes) as bigint) as n_bytes, count(*) filter (where picked) as read_blocks, cast(coalesce(sum(n_bytes) filter (where picked), 0) as bigint) as read_bytes
      from picks group by query""",
    "search_fields": f"""{_NOTES}, scored as (select path, lower(path) in ('archived', 'project', 'tion') as exact,
        cast(contains(lower(body), 'archived') as bigint) + cast(contains(lower(body), 'project') as bigint) + cast(contains(lower(body), 'tion') as bigint) as text_hits,
        cast(status = 'archived' as bigint) + cast(type = 'project' as bigint) as meta_hits from notes)
      select * from scored where exact or text_hits > 0 or meta_hits > 0""",
    "search_json": f"""{_FOUND} select '{{"doc_id":' || doc_id || ',"rank":' || rank || '}}' as value from ranked where rank <= 20""",
    "search_originals": f"{_FOUND} select rank, doc_id, lang, source, n_chars, text from ranked where rank <= 20",
    "search_originals_indexed": f"{_FOUND} select rank, doc_id, lang, source, n_chars, text from ranked where rank <= 20",
    "link_indegree": f"{_LINKS} select target, count(*) as n_links, count(distinct source) as n_sources from links group by target",
    "link_audit": f"""{_RESOLVED} select 'body' as origin, case when resolved is null then 'unresolved' else 'resolved' end as status, count(*) as n_links,
      count(distinct target) as n_targets from resolved group by 2""",
    "link_unresolved": f"{_RESOLVED} select distinct 'broken-link' as rule, cast(source as varchar) as path, target as detail, 'block' as severity from resolved where resolved is null",
    "link_candidates": """with names as (select distinct source || '/n' || (doc_id * 37 % 10007) || '.md' as candidate, source || '/n' || (doc_id * 37 % 10007) as n from documents),
      broken as (select distinct 'SRC' || (page_id % 20) || '/n' || (page_id * 91 % 10007) as target from pages),
      near as (select target, candidate, cast(levenshtein(lower(target), n) as int) as distance from broken, names where levenshtein(lower(target), n) <= 1)
      select * from near qualify distance = min(distance) over (partition by target)""",
    "link_components": f"""with recursive links as (select page_id as source, unnest({_HREF}) as target from pages),
      edges as (select distinct 'page:' || source as a, 'to:' || target as b from links) {_REACH}
      select a as node, min(b) as component from reach group by a""",
    "link_connectivity": f"""with recursive docs as (select cast(doc_id as varchar) as path, doc_id, quality from labels),
      edges as (select path as a, cast(doc_id - doc_id % 7 as varchar) as b from docs where doc_id % 7 <> 0 and cast(doc_id - doc_id % 7 as varchar) in (select path from docs)) {_REACH},
      found as (select a, min(b) as component from reach group by a),
      full_set as (select path, coalesce(component, path) as component, a is null as isolated from docs left join found on a = path)
      select path, component, count(*) over (partition by component) as n_members, isolated from full_set""",
    "graph_neighbourhood": f"""{_LINKS}, edges as (select distinct 'page:' || source as a, 'to:' || target as b from links),
      both_ways as (select a, b from edges union select b, a from edges),
      vertices as (select 'page:' || page_id as path, {_TITLE} as title from pages union all select distinct b, b from edges),
      d0 as (select distinct path from vertices where contains(lower(concat_ws(' ', path, title)), 'thble')),
      d1 as (select distinct b as path from both_ways where a in (from d0)),
      d2 as (select distinct b as path from both_ways where a in (from d1))
      select path, cast(min(distance) as int) as distance from (select path, 0 as distance from d0 union all select path, 1 from d1 union all select path, 2 from d2) group by path""",
    "unlinked_mentions": f"""with titles as (select distinct {_TITLE} as name from pages), needles as (
        select name, ' ' || trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as needle from titles where name is not null),
      hay as (select doc_id, ' ' || trim(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as hay from documents)
      select distinct doc_id as id, name from hay join needles on contains(hay, needle) where len(string_split(trim(needle), ' ')) >= 2""",
    "lint_status_enum": f"{_PRINTED} ({_ENUM})",
    "lint_row_count": f"{_PRINTED} ({_COUNTS})",
    "lint_catalog": _CATALOG,
    "lint_archived": "select cast(doc_id as varchar) as path, source as detail from documents where doc_id in (select doc_id from labels where toxic = 1)",
    "lint_revisit": """select 'revisit-due' as rule, cast(o_orderkey as varchar) as path, strftime(o_orderdate, '%Y-%m-%d') as detail, 'advisory' as severity
      from orders where cast(o_orderdate as date) < date '1996-01-01'""",
    "lint_beyond_baseline": f"select path, fingerprint from ({_PRINTED} ({_ENUM})) where cast(path as bigint) % 3 <> 0",
    "lint_gate": f"""{_DRIFT}, every as (select severity from ({_ENUM}) union all select severity from ({_COUNTS}) union all select severity from ({_SOURCES}) union all select severity from found)
      select count(*) filter (where severity = 'block') = 0 as passed, count(*) filter (where severity = 'block') as blocking, count(*) filter (where severity <> 'block') as advisory from every""",
    "lint_changed": f"select path, detail from ({_ENUM}) where path in (select cast(page_id as varchar) from pages)",
    "lint_sources": f"{_PRINTED} ({_SOURCES})",
    "lint_fixtures": """select cast(d.doc_id as varchar) as path, sha256(text) as detail, 'block' as severity from documents d join labels l on l.doc_id = d.doc_id where quality = 0 and length(text) > 0
      union all select '-1', 'missing', 'block'""",
    "lint_changelog": """select 'changelog-sync' as rule, 'CHANGELOG' as path, strftime(min(ts), '%Y-%m-%d') || ' / ' || strftime(max(ts), '%Y-%m-%d') as detail, 'advisory' as severity
      from events having strftime(min(ts), '%Y-%m-%d') <> strftime(max(ts), '%Y-%m-%d')""",
    "drift_report": f"""{_DRIFT} select '{{"rule":"' || rule || '","path":"' || path || '","detail":"' || detail || '","severity":"' || severity || '"}}' as value from found""",
    "search_envelopes": f"""{_FOUND} select 'found' as name, 'search' as mode, null as reason, 0 as exit_code, (select count(*) from ranked where rank <= 20) as n_results
      union all from (values ('nothing found', 'search', null, 0, 0), ('empty corpus', 'filtered-empty', 'empty-corpus', 2, 0), ('filters leave nothing', 'filtered-empty', 'filters-exclude-all', 2, 0),
      ('no query', 'usage', 'usage', 1, 0), ('bad limit', 'usage', 'usage', 1, 0), ('unreadable', 'unreadable', 'unreadable-corpus', 3, 0), ('internal', 'error', 'no reader', 5, 0))""",
    "link_origins": f"""{_LINKED} select origin, case when resolved is null then 'unresolved' else 'resolved' end as status, count(*) as n_links, count(distinct target) as n_targets from found group by 1, 2""",
    "graph_cached": f"""{_LINKED}, edges as (select path as a, resolved as b from found where resolved <> path union select resolved, path from found where resolved <> path),
      d0 as (select path from notes where contains(lower(path || ' ' || title), 'doc 11'))
      select path, cast(min(distance) as int) as distance from (select path, 0 as distance from d0 union all select b, 1 from edges where a in (from d0)) group by path""",
    "parsed_notes": f"{_NOTES} select path, title, type, status, 2 as n_body, cast(doc_id + 7 as varchar) as related, cast(length(body) as bigint) as n_chars from notes",
    "parsed_router": "select source as category, count(*) as declared_rows, 'index-' || source as catalog, 'documents of ' || source as descr from documents group by source",
    "parsed_research": "select 'index-' || doc_id as catalog, 'Live' as section, source || '/' || doc_id as link, lang as kind, 'of ' || n_chars as summary from documents",
    "parsed_log": "select strftime(ts, '%Y-%m-%d') as event_date, event_type, 'event ' || event_id as text from events",
    "session_context": f"""{_NOTES} select 'router' as part, row_number() over (order by source) as rank, source as name, 'index-' || source as detail from (select distinct source from notes)
      union all select * from (select 'recent', row_number() over (order by length(body) desc, path) as k, path, title from notes where type = 'project' and status = 'active') where k <= 3
      union all select 'active-now', row_number() over (order by type), type, cast(count(*) as varchar) from notes where status = 'active' group by type""",
    "category_pages": f"{_NOTES} select 'index-src3' as catalog, path, title, status from notes where source = 'src3'",
    "lint_canonical_facts": "select sha256(text) as fact_key, cast(count(*) as varchar) as n_pages from documents group by text having count(distinct doc_id) > 1",
    "transcripts": """select conv_id as session, count(*) as n_turns, cast(length(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn)) as bigint) as n_chars,
      string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn) as transcript from conversations group by conv_id""",
    "qualifying_sessions": "select conv_id as session, count(*) as n_turns from conversations group by 1 having count(*) >= 4 and bool_or(role = 'user') and bool_or(role = 'assistant')",
    "pending_sessions": "select conv_id as session, count(*) as n_turns from conversations where conv_id % 3 <> 0 group by 1 having count(*) >= 2 and bool_or(role = 'user') and bool_or(role = 'assistant')",
    "promoted": "select doc_id as proposal_id, source from documents where doc_id in (select doc_id from labels where quality = 1 and toxic = 0)",
    "recent_active": "select doc_id as path, n_chars from documents where lang = 'en' order by n_chars desc, doc_id limit 3",
    "catalog_refresh": """select doc_id as link, lang as summary from documents where doc_id not in (select doc_id from labels)
      union all select doc_id, 'quality ' || quality from labels where toxic <> 1""",
    "log_lines": "select '## [' || strftime(ts, '%Y-%m-%d') || '] ' || event_type || ' | event ' || event_id as value from events",
    "session_ends": """with marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as opens from events),
      numbered as (select *, sum(opens) over (partition by user_id order by ts, event_id) as k from marked)
      select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as ended, count(*) as n_events, max(value) as most
      from numbered group by user_id, k""",
    "events_hourly": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by 1, 2",
    "page_title": f"select page_id, {_TITLE} as title from pages",
    "page_text": f"select page_id, t as text, cast(length(t) as bigint) as n_chars from (select page_id, {_STRIPPED} as t from pages)",
    "page_content": """with articles as (select page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as x from pages),
      parts as (select page_id, html, list_filter(list_transform(regexp_split_to_array(replace(x, '<b>', ''), '</?(?:p|h1)>'),
        lambda t: trim(regexp_replace(regexp_replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda t: t <> '') as found from articles)
      select page_id, """
    + _TITLE
    + """ as title, array_to_string(found, chr(10)) as text, len(found) as n_blocks from parts""",
    "page_domains": """with urls as (select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from pages),
      cut as (select *, string_split(host, '.') as l from urls),
      sized as (select *, case when host = 'tionble.example.org' or suffix(host, '.tionble.example.org') then 2 when suffix(host, '.example.org') then 3 when host = 'example.com' or suffix(host, '.example.com') then 2 else 1 end as n from cut)
      select page_id, host, array_to_string(l[-n:], '.') as public_suffix, case when len(l) > n then array_to_string(l[-n - 1:], '.') end as domain from sized""",
    "page_fields": "select page_id, url, " + ", ".join(f"nullif(trim(regexp_extract(coalesce(html, ''), '{p}', 1)), '') as {n}" for n, p in _FIELD.items()) + " from pages",
    "page_render_status": f"""select page_id, case when s then 'render-unavailable' else 'ok' end as status, case when s then 3 else 0 end as exit_code
      from (select page_id, regexp_matches(coalesce(html, ''), '(?i)<script\\b') and length({_STRIPPED}) < 600 as s from pages)""",
    "page_markdown": "select '| ' || page_id || ' | ' || replace(regexp_replace(url, '\\s+', ' ', 'g'), '|', '\\|') || ' |' as value from pages",
    "pending_pages": "select page_id, url from pages where url not in (select url from pages where page_id % 4 = 0)",
    "blocked_terms": "select doc_id from documents where not contains(lower(text), 'license') and not contains(lower(text), 'copyright') and not contains(lower(text), 'ndwhst')",
    "blocked_phrases": """with items as (select string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') as w from benchmark),
      terms as (select distinct lower(array_to_string(w[i : i + 2], ' ')) as term from items, unnest(range(1, len(w) - 1)) as t(i) where len(w) >= 3)
      select doc_id from documents where not exists (select 1 from terms where contains(lower(coalesce(text, '')), term))""",
    "word_frequency": """select word, count(*) as n_docs from (
      select unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) as word from documents) where word <> '' group by word""",
}
