"""Reading a vault of Markdown: notes, catalogs, the router, logs, terms.

Each parser is a function of a DataFrame (path, text), so it also takes text
from any other source; ``read_markdown`` makes one from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import wikilinks


def vault_root(*named: str | None, default: str) -> str:
    """The first place that is named and not empty, else the default."""
    return next(filter(None, named), default)


#: Session setting that holds the vault's root for all that read it later.
ROOT_CONF = "spark.vellumine.vault"


def use_vault(spark: SparkSession, named: str | None = None, default: str = ".") -> str:
    """Settles the vault's root: as named, else as the session has it, else the default; kept in the session."""
    root = vault_root(named, spark.conf.get(ROOT_CONF, None), default=default)
    spark.conf.set(ROOT_CONF, root)
    return root


def read_markdown(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Every Markdown file under path, else under the vault that the session names, whole: (path, text)."""
    path = path or use_vault(spark)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "line"))


def _field(front: Column, name: str) -> Column:
    value = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(F.trim(value) == "", None).otherwise(F.regexp_replace(F.trim(value), r"""^(["'])(.*)\1$""", "$2"))


def _list_field(front: Column, name: str) -> Column:
    """The values of a field that is a list, ``[a, b]`` or a line ``- a`` each, or one value; quotes are taken off."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[([^\]\n]*)\][ \t]*$", 1)
    lines = F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t\r]*$"), F.lit(1))
    single = F.when(~F.startswith(_field(front, name), F.lit("[")), F.array(_field(front, name)))
    values = F.when(inline != "", F.split(inline, ",")).when(F.size(lines) > 0, lines).otherwise(F.coalesce(single, F.array().cast("array<string>")))
    return F.filter(F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2")), lambda v: v != "")


def front_fields(front: Column) -> Column:
    """All fields of a frontmatter as a map of names to values; of a name that stands twice the first counts.

    A value is what stands behind the colon, without quotes; a field with lines of its own has an empty one.
    """
    pattern = r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t\r]*$"
    names, values = (F.regexp_extract_all(F.coalesce(front, F.lit("")), F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2").alias("v")))
    firsts = F.filter(pairs, lambda p, i: F.array_position(names, p["n"]) == i + 1)
    return F.map_from_entries(firsts)


def parse_notes(files: DataFrame) -> DataFrame:
    """``(path, title, type, status, summary, revisit, aliases, front, body, body_links, front_links)``.

    Frontmatter is what stands between a first line ``---`` and the next one.
    The title falls back to the first heading.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)"
    front = F.regexp_extract(text, pattern, 1)
    body = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 2)).otherwise(text)
    cut = files.select("path", front.alias("front"), body.alias("body"))
    heading = F.regexp_extract("body", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return cut.select(
        "path",
        F.coalesce(_field(F.col("front"), "title"), F.when(heading != "", heading)).alias("title"),
        *[_field(F.col("front"), name).alias(name) for name in ("type", "status", "summary")],
        F.try_to_date(_field(F.col("front"), "revisit"), "yyyy-MM-dd").alias("revisit"),
        _list_field(F.col("front"), "aliases").alias("aliases"),
        "front",
        "body",
        wikilinks(F.col("body")).alias("body_links"),
        wikilinks(F.col("front")).alias("front_links"),
    )


def parse_catalog(files: DataFrame) -> DataFrame:
    """``(catalog, section, link, summary)`` of rows ``| [[path/name]] | summary |``.

    A row without a wikilink, as a placeholder is, counts as none.
    """
    lines = _lines(files)
    marks = F.collect_list(F.when(F.startswith("line", F.lit("## ")), F.struct("line_no", F.substr("line", F.lit(4)).alias("name"))))
    sections = lines.groupBy("path").agg(marks.alias("marks"))
    rows = lines.where(F.regexp_like("line", F.lit(r"^\s*\|\s*\[\[")))
    cells = rows.join(sections, "path").select(
        F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1).alias("catalog"),
        F.array_max(F.filter("marks", lambda m: m["line_no"] < F.col("line_no")))["name"].alias("section"),
        F.trim(F.regexp_extract("line", r"\[\[([^\]|#\\]+)", 1)).alias("link"),
        F.trim(F.regexp_extract("line", r"\]\]\s*\|\s*(.*?)\s*\|?\s*$", 1)).alias("summary"),
    )
    return cells


def parse_research(files: DataFrame) -> DataFrame:
    """Catalog rows whose summary is ``kind — text``: (catalog, section, link, kind, summary)."""
    parts = F.split("summary", " — ", 2)
    return parse_catalog(files).select("catalog", "section", "link", F.when(F.size(parts) > 1, parts[0]).alias("kind"), F.element_at(parts, -1).alias("summary"))


def parse_router(files: DataFrame) -> DataFrame:
    """``(category, declared_rows, catalog, descr)`` of rows ``| category | count | [[catalog]] | text |``."""
    pattern = r"^\s*\|\s*(.*?)\s*\|\s*(\d+)\s*\|\s*\[\[([^\]|#\\]+)\]\]\s*\|\s*(.*?)\s*\|?\s*$"
    rows = _lines(files).where(F.regexp_like("line", F.lit(pattern)))
    return rows.select(F.regexp_extract("line", pattern, 1).alias("category"), F.regexp_extract("line", pattern, 2).cast("long").alias("declared_rows"), F.regexp_extract("line", pattern, 3).alias("catalog"), F.regexp_extract("line", pattern, 4).alias("descr"))


def parse_updated(files: DataFrame) -> DataFrame:
    """``(path, updated)``: the date of a line ``Last updated: YYYY-MM-DD``, or the latest one that heads a section ``## YYYY-MM-DD``; else null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stated = F.regexp_extract(text, r"(?m)^Last updated:\s*(\d{4}-\d{2}-\d{2})", 1)
    heads = F.array_max(F.regexp_extract_all(text, F.lit(r"(?m)^##\s+\[?(\d{4}-\d{2}-\d{2})"), 1))
    return files.select("path", F.try_to_date(F.when(stated != "", stated).otherwise(heads), "yyyy-MM-dd").alias("updated"))


def parse_log(files: DataFrame) -> DataFrame:
    """``(event_date, event_type, text)`` of lines ``## [YYYY-MM-DD] type | text``."""
    pattern = r"^## \[(\d{4}-\d{2}-\d{2})\]\s+([^|]+?)\s*\|\s*(.*?)\s*$"
    rows = _lines(files).where(F.regexp_like("line", F.lit(pattern)))
    return rows.select(F.try_to_date(F.regexp_extract("line", pattern, 1), "yyyy-MM-dd").alias("event_date"), F.regexp_extract("line", pattern, 2).alias("event_type"), F.regexp_extract("line", pattern, 3).alias("text"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Blocked terms, one a line: (term); blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term != ''").distinct()
