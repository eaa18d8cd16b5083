"""The link graph of a vault or of a set of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import plain
from vellumine.operators.components import connected_components
from vellumine.plans.durable import materialise
from vellumine.plans.phrases import find_phrases
from vellumine.plans.skew import meet

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def note_links(notes: DataFrame) -> DataFrame:
    """``(source, target, origin)``: a row per wikilink, from the body and from the frontmatter."""
    parts = [notes.select(F.col("path").alias("source"), F.explode(f"{origin}_links").alias("target"), F.lit(name).alias("origin")) for origin, name in (("body", "body"), ("front", "frontmatter"))]
    return parts[0].unionByName(parts[1])


def page_links(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(source, target)``: a row per href of an anchor."""
    return pages.select(F.col(id_column).alias("source"), F.explode(F.regexp_extract_all(F.coalesce(html_column, F.lit("")), F.lit(HREF), 1)).alias("target"))


def _name(path: Column) -> Column:
    """A path as links write it: lower case, no extension."""
    return F.regexp_replace(F.lower(F.trim(path)), r"\.md$", "")


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds ``resolved``, the path of the note that a link means, or null.

    A target is a path from the vault's root, or the end of one, or else one of a
    note's ``aliases``, if notes have that column; of several notes the shortest
    path is meant, then the first by name.  Case and the extension don't matter.
    """
    paths = notes.select("path", _name(F.col("path")).alias("name"))
    segments = F.split("name", "/")
    keys = paths.select("path", F.lit(0).alias("kind"), F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))).alias("key"))
    if "aliases" in notes.columns:
        keys = keys.unionByName(notes.select("path", F.lit(1).alias("kind"), F.explode(F.transform("aliases", _name)).alias("key")))
    best = keys.groupBy("key").agg(F.min(F.struct("kind", F.length("path"), F.col("path").alias("path")))["path"].alias("resolved"))
    return links.withColumn("key", _name(F.col("target"))).join(best, "key", "left").drop("key")


def _without(name: Column, deletions: int) -> Column:
    """What is left of a name after up to so many deletions of a character."""
    out = F.array(name)
    for _ in range(deletions):
        shorter = F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.left(x, i - 1), F.substr(x, i + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def link_candidates(broken: DataFrame, names: DataFrame, distance: int = 1) -> DataFrame:
    """``(target, candidate, distance)``: for each broken target the nearest of the names, within an edit distance.

    ``broken`` (target) and ``names`` (name) are compared in lower case, without
    the extension.  Two names within d edits have a string in common that each
    gives by at most d deletions, so both are exploded into those, joined where
    they are equal, and then measured: no pair is missed, and none is tried that
    shares no such string.  Ties give all names at that distance; null and empty
    ones have no candidates.
    """
    def index(rows: DataFrame, column: str, key: str) -> DataFrame:
        distinct = rows.select(column, _name(F.col(column)).alias(key)).where(f"{key} != ''").distinct()
        return distinct.withColumn("left", F.explode(F.transform(_without(F.col(key), distance), lambda x: F.xxhash64(x))))

    pairs = index(broken, "target", "t").join(index(names.withColumnRenamed("name", "candidate"), "candidate", "n"), "left").select("target", "candidate", "t", "n").distinct()
    near = pairs.select("target", "candidate", F.levenshtein("t", "n", distance).alias("distance")).where("distance >= 0")
    best = near.groupBy("target").agg(F.min(F.struct("distance", "candidate"))["distance"].alias("least"), F.collect_list(F.struct("candidate", "distance")).alias("all"))
    return best.select("target", F.explode(F.filter("all", lambda x: x["distance"] == F.col("least"))).alias("x")).select("target", "x.candidate", "x.distance")


def audit(links: DataFrame) -> DataFrame:
    """``(origin, status, n_links, n_targets)`` of resolved links."""
    status = F.when(F.col("resolved").isNull(), "unresolved").otherwise("resolved")
    return links.groupBy("origin", status.alias("status")).agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"))


def in_degree(links: DataFrame) -> DataFrame:
    """``(target, n_links, n_sources)``."""
    return links.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("source").alias("n_sources"))


def build_graph(links: DataFrame, notes: DataFrame, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, title, type, status) and edges (source, target, weight); written only if cache is given."""
    edges = links.where("resolved is not null and resolved != source").groupBy("source", F.col("resolved").alias("target")).agg(F.count("*").alias("weight"))
    vertices = notes.select("path", "title", "type", "status")
    if cache:
        vertices.write.mode("overwrite").parquet(f"{cache}/vertices")
        edges.write.mode("overwrite").parquet(f"{cache}/edges")
    return vertices, edges


def read_graph(spark: SparkSession, cache: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges that ``build_graph`` wrote."""
    return spark.read.parquet(f"{cache}/vertices"), spark.read.parquet(f"{cache}/edges")


def connectivity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, component, n_members, isolated)``; isolated notes have no link at all."""
    found = connected_components(edges, "source", "target")
    full = vertices.select("path").join(found, F.col("path") == F.col("node"), "left").select("path", F.coalesce("component", "path").alias("component"), F.col("node").isNull().alias("isolated"))
    sizes = full.groupBy("component").agg(F.count("*").alias("n_members"))
    return full.join(sizes, "component").select("path", "component", "n_members", "isolated")


def connectivity_exit_code(found: DataFrame) -> int:
    """2 if a note is isolated: a finding, not a failure."""
    return 0 if found.where("isolated").isEmpty() else 2


def unlinked_mentions(texts: DataFrame, titles: DataFrame, links: DataFrame | None = None, min_words: int = 2) -> DataFrame:
    """``(id, name)``: texts (id, text) with a title (name, title) in them, as whole words, but no link to it.

    Titles under ``min_words``, and those without a word, are too common to tell.
    Each text is read where it stands, for all titles at once, and only what it
    mentions meets the titles in a join.  Links (id, name) are taken out by an
    anti join.
    """
    needle = plain(F.col("title"))
    long_enough = (F.trim("needle") != "") & (F.size(F.split(F.trim("needle"), " ")) >= min_words)
    names = materialise(titles.select("name", needle.alias("needle")).where(long_enough).distinct())
    found = materialise(find_phrases(texts.select("id", plain(F.col("text")).alias("hay")), names.select("needle").distinct()))
    counts = found.groupBy("needle").agg(F.count("*").alias("n_found"))
    keyed = counts.join(names.groupBy("needle").agg(F.collect_list("name").alias("names")), "needle")
    met = meet(found, keyed, ["needle"], "n_found").select("id", F.explode("names").alias("name")).distinct()
    return met if links is None else met.join(links.select("id", "name"), ["id", "name"], "left_anti")


def neighbourhood(vertices: DataFrame, edges: DataFrame, keyword: str, hops: int = 1) -> DataFrame:
    """``(path, distance)`` of notes within so many links, either way, of one whose path or title has the keyword."""
    low = keyword.lower()
    seen = vertices.where(F.contains(F.lower(F.concat_ws(" ", "path", "title")), F.lit(low))).select("path", F.lit(0).alias("distance"))
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct()
    for distance in range(1, hops + 1):
        step = seen.join(both, F.col("path") == F.col("source")).select(F.col("target").alias("path"), F.lit(distance).alias("distance"))
        seen = seen.union(step).groupBy("path").agg(F.min("distance").alias("distance"))
    return seen
