"""Structured extraction from web pages, by patterns on the JVM side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import strip_markup
from vellumine.plans import automata
from vellumine.plans.automata import Strings
from vellumine.sources.markdown import MarkdownTable

# What a page that needs a browser is answered with.
RENDER_UNAVAILABLE, RENDER_EXIT = "render-unavailable", 3


def page_title(html: Column) -> Column:
    """The content of the title element, white space folded; null if there is none."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    return F.when(title != "", title)


def page_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(page_id, text, n_chars)`` with all markup stripped."""
    return pages.select(F.col(id_column), strip_markup(F.col(html_column)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _content(batches):
    import pyarrow as pa

    from vellumine.functions.page_blocks import main_blocks, to_markdown

    for batch in batches:
        found = [main_blocks(x or "") for x in batch.column("html").to_pylist()]
        texts = ["\n".join(b.text for b in page if b.text) for page in found]
        columns = [batch.column("page_id"), batch.column("title"), pa.array(texts, pa.string()), pa.array([to_markdown(page) for page in found], pa.string()), pa.array([len(page) for page in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "title", "text", "markdown", "n_blocks"])


def page_content(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(page_id, title, text, markdown, n_blocks)``: what a page is about, a line per block, and as Markdown.

    Kept are the blocks of its main element, else of its articles, else all that
    stand in no menu, header, footer, form or the like.  Lists nest, tables have
    a head, links, emphasis, code and images stay.  One scan; null pages are
    empty; rows that repeat are read each.
    """
    html = F.col(html_column)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), page_title(html).alias("title"), html.alias("html"))
    return rows.mapInArrow(_content, "page_id long, title string, text string, markdown string, n_blocks long")


def render_status(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", min_chars: int = 40) -> DataFrame:
    """``(page_id, status, exit_code)``: a page of scripts with next to no text needs a browser, which is not offered."""
    text = strip_markup(F.col(html_column))
    scripted = F.regexp_like(F.coalesce(html_column, F.lit("")), F.lit(r"(?i)<script\b"))
    unavailable = scripted & (F.length(text) < min_chars)
    return pages.select(F.col(id_column), F.when(unavailable, RENDER_UNAVAILABLE).otherwise("ok").alias("status"), F.when(unavailable, RENDER_EXIT).otherwise(0).alias("exit_code"))


def collect_fields(pages: DataFrame, fields: dict[str, str], keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """Named fields of each page: the first group of each field's pattern, null where it does not match."""
    out = []
    for name, pattern in fields.items():
        value = F.trim(F.regexp_extract(F.coalesce(html_column, F.lit("")), pattern, 1))
        out.append(F.when(value != "", value).alias(name))
    return pages.select(*keep, *out)


#: Blocked terms that make one predicate.
PREDICATE_TERMS = 50


def _holds_none(terms: Strings, column: str):
    """Rows without any of the terms, by an automaton over all of them."""

    def run(batches):
        import pyarrow as pa

        automaton = terms.automaton()
        for batch in batches:
            texts = batch.column(column).to_pylist()
            yield batch.filter(pa.array([next(automaton.iter(x), None) is None for x in texts], pa.bool_()))

    return run


def _free_name(rows: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as tell it from the columns there are."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_blocked(rows: DataFrame, terms: DataFrame, text_column: str) -> DataFrame:
    """Rows whose text holds none of the terms, in any case.

    A short list becomes one predicate in the scan, which lowers each text once; a
    longer one an automaton that reads each text once, several in turn if the
    list is very long.  Null and empty terms are none; a null text holds none;
    columns of rows may have any names.
    """
    low = F.lower(F.coalesce(text_column, F.lit("")))
    terms = terms.select(F.lower("term").alias("term")).where("term != ''").distinct()
    few = [r["term"] for r in terms.limit(PREDICATE_TERMS + 1).collect()]
    if not few:
        return rows
    if len(few) <= PREDICATE_TERMS:
        return rows.where(~F.exists(F.array(low), lambda text: reduce(or_, [F.contains(text, F.lit(t)) for t in few])))
    size = terms.agg(F.sum(F.length("term"))).first()[0]
    shards, lowered = -(-size // automata.AUTOMATON_CHARS), _free_name(rows, "_lower")
    rows = rows.withColumn(lowered, low)
    for k in range(shards):
        part = [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k).collect()]
        if part:
            rows = rows.mapInArrow(_holds_none(Strings(rows.sparkSession, part), lowered), rows.schema)
    return rows.drop(lowered)


def pending_pages(pages: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Pages that a crawl's checkpoint does not hold yet."""
    return pages.join(done.select(key), key, "left_anti")


def as_markdown(rows: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, without its head; bars in cells are escaped."""
    cells = [F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write(rows: DataFrame, path: str, form: str) -> None:
    """Write collected fields as json, csv or markdown: files of rows, csv and markdown with a head each."""
    if form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif form == "markdown":
        rows.sparkSession.dataSource.register(MarkdownTable)
        rows.select([F.col(f"`{c}`").cast("string") for c in rows.columns]).write.format("markdown-table").mode("overwrite").save(path)
    else:
        raise ValueError(f"unknown form: {form}")


#: Suffix rules that are broadcast; a host name has at most 253 characters.
BROADCAST_RULES = 200_000


def registrable_domains(urls: DataFrame, suffixes: DataFrame, url_column: str = "url") -> DataFrame:
    """Adds ``host``, ``public_suffix`` and ``domain``, the suffix with one label more.

    ``suffixes`` (rule) says where names are registered: ``co.uk``; ``*.ck``, any
    label in front of ck; ``!www.ck``, but not that one.  The longest rule that
    fits decides, an exception before all others, and ``*`` where none fits.  Case,
    a user, a port and a last dot don't matter.  Addresses of numbers, hosts that
    are a suffix themselves, and texts that are no URL have no domain.

    Rules are joined once for each number of labels they have, and broadcast up to
    ``BROADCAST_RULES`` of them, so a URL stays where it is.
    """
    place = F.regexp_extract(F.coalesce(url_column, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(F.lower(place), r"\.$", "")
    rules = suffixes.select(F.lower(F.trim("rule")).alias("rule")).where("rule != ''").distinct()
    rules = rules.select(F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("_of"), F.startswith("rule", F.lit("!")).alias("_except"), F.startswith("rule", F.lit("*.")).alias("_any"))
    rules = rules.where("_of != '*'").groupBy("_of").agg(F.max("_except").alias("_except"), F.max("_any").alias("_any"), F.max(~F.col("_any") & ~F.col("_except")).alias("_plain"))
    sizes = sorted(r[0] for r in rules.select(F.size(F.split("_of", r"\."))).distinct().collect())
    few = suffixes.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    names = [c for c in urls.columns if c not in ("host", "public_suffix", "domain")]
    out = urls.select(*names, host.alias("host")).withColumn("_labels", F.split("host", r"\."))
    n, count = F.lit(1), F.size("_labels")
    excepted = F.lit(None).cast("int")
    for k in sizes:
        of_k = rules.where(F.size(F.split("_of", r"\.")) == k).select("_of", F.struct("_except", "_any", "_plain").alias(f"_rule_{k}"))
        last = F.when(count >= k, F.array_join(F.slice("_labels", -k, k), "."))
        out = out.join(F.broadcast(of_k) if few else of_k, last == F.col("_of"), "left").drop("_of")
        rule = F.col(f"_rule_{k}")
        n = F.greatest(n, F.when(rule["_any"] & (count > k), k + 1).when(rule["_plain"], k).otherwise(1))
        excepted = F.when(rule["_except"], k - 1).otherwise(excepted)
    numbers = F.regexp_like("host", F.lit(r"^\[|^[0-9.]+$")) | (F.col("host") == "") | F.regexp_like("host", F.lit(r"(^|\.)(\.|$)"))
    out = out.select(*names, "host", "_labels", F.when(~numbers, F.coalesce(excepted, n)).alias("_n"))

    def last(m: Column) -> Column:
        return F.when(F.size("_labels") >= m, F.array_join(F.slice("_labels", -m, m), "."))

    return out.select(*names, "host", last(F.col("_n")).alias("public_suffix"), last(F.col("_n") + 1).alias("domain"))
