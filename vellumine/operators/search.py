"""Ranked search: full-text grep, metadata keywords, identifiers, freshness.

The order of the ranking is this engine's own choice: exact identifiers first,
stale entries after fresh ones, then more text hits, more metadata hits, and the
smaller id.  Nothing is hidden for being stale.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Fields:
    """Where a corpus keeps what a search looks at."""

    id: str = "doc_id"
    text: str = "text"
    metadata: tuple[str, ...] = ("lang", "source")
    #: A boolean column: the entry's status is terminal.
    stale: str = "stale"
    #: A map column, all of whose values are metadata too, as ``sources.vault.front_fields`` makes it.
    fields: str | None = None


def terms_of(query: str) -> list[str]:
    """Lower-case terms, each once, in order."""
    return list(dict.fromkeys(query.lower().split()))


def with_freshness(docs: DataFrame, statuses: DataFrame, id_column: str, terminal: Column, stale: str = "stale") -> DataFrame:
    """Adds whether any status row of an entry is terminal, in place of a column of that name; entries without one are fresh."""
    flags = freshness(statuses, id_column, terminal, "_flag").select(F.col(id_column).alias("_of"), "_flag")
    kept = [docs[c] for c in docs.columns if c != stale]
    return docs.join(flags, docs[id_column] == F.col("_of"), "left").select(*kept, F.coalesce("_flag", F.lit(False)).alias(stale))


def freshness(statuses: DataFrame, id_column: str, terminal: Column, stale: str = "stale") -> DataFrame:
    """``(id, stale)``: whether any status row of an entry is terminal."""
    return statuses.groupBy(id_column).agg(F.max(terminal).alias(stale))


def _count(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(c, F.lit(False)).cast("int")
    return out.cast("long")


def _looked_at(terms: list[str], fields: Fields) -> Column:
    """What the terms find in an entry, as one struct.

    The lowered text is the argument of a lambda, so it is made once for all terms,
    and the struct is exploded from an array of one, so that a filter on it does
    not write the expression out again.
    """
    exact = F.coalesce(F.lower(F.col(fields.id).cast("string")).isin(terms), F.lit(False)) if terms else F.lit(False)
    meta = _count([F.lower(F.col(m).cast("string")) == t for t in terms for m in fields.metadata])
    if fields.fields:
        values = F.transform(F.map_values(fields.fields), lambda v: F.lower(v))
        meta = meta + F.coalesce(F.size(F.filter(values, lambda v: v.isin(terms))), F.lit(0)) if terms else meta

    def look(low: Column) -> Column:
        return F.struct(exact.alias("exact"), _count([F.contains(low, F.lit(t)) for t in terms]).alias("text_hits"), meta.alias("meta_hits"))

    return F.explode(F.transform(F.array(F.lower(fields.text)), look))


def matches(docs: DataFrame, query: str, fields: Fields = Fields(), flags: DataFrame | None = None) -> DataFrame:
    """All entries that a query finds: (id, exact, stale, text_hits, meta_hits).

    A term hits a text that contains it in lower case, and a metadata field that
    equals it; an identifier is exact if a term equals it.  One scan, no shuffle
    of texts: ``flags``, as ``freshness`` gives them, are joined to what was found.
    """
    stale = F.coalesce(F.col(fields.stale), F.lit(False)) if fields.stale in docs.columns else F.lit(False)
    found = docs.select(F.col(fields.id), stale.alias("stale"), _looked_at(terms_of(query), fields).alias("found"))
    found = found.select(fields.id, "found.exact", "stale", "found.text_hits", "found.meta_hits").where("exact or text_hits > 0 or meta_hits > 0")
    if flags is None:
        return found
    named = flags.select(fields.id, F.col(fields.stale).alias("_stale"))
    return found.join(named, fields.id, "left").select(fields.id, "exact", F.coalesce("_stale", F.lit(False)).alias("stale"), "text_hits", "meta_hits")


def search(docs: DataFrame, query: str, limit: int = 20, fields: Fields = Fields(), explain: bool = False, flags: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` entries with their rank; with ``explain`` an array of reasons.

    The limit is taken per partition before rows meet, so only ``limit`` rows of
    each are moved.
    """
    order = [F.desc("exact"), F.asc("stale"), F.desc("text_hits"), F.desc("meta_hits"), F.asc(fields.id)]
    top = matches(docs, query, fields, flags).orderBy(*order).limit(limit)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    if explain:
        reasons = [
            F.when(F.col("exact"), F.lit("identifier")),
            F.when(F.col("text_hits") > 0, F.concat(F.lit("text:"), F.col("text_hits").cast("string"))),
            F.when(F.col("meta_hits") > 0, F.concat(F.lit("metadata:"), F.col("meta_hits").cast("string"))),
            F.when(F.col("stale"), F.lit("terminal-status")),
        ]
        out = out.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ","))
    return out


def originals(found: DataFrame, docs: DataFrame, fields: Fields = Fields()) -> DataFrame:
    """The whole entries that a search found, in its order; found is small, so docs is not shuffled."""
    return docs.join(F.broadcast(found.select(fields.id, "rank")), fields.id).orderBy("rank")


# Modes, reasons and exit codes that callers of a search rely on.
FILTERED_EMPTY = "filtered-empty"
EMPTY_CORPUS, FILTERS_EXCLUDE_ALL = "empty-corpus", "filters-exclude-all"
OK, USAGE, EMPTY, UNREADABLE, INTERNAL = 0, 1, 2, 3, 5


@dataclass
class Envelope:
    """What a search always answers with, as JSON."""

    mode: str
    exit_code: int
    reason: str | None = None
    results: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, default=str)


def run_search(load, query: str | None, limit: int = 20, fields: Fields = Fields(), filters: Column | None = None, explain: bool = False) -> Envelope:
    """A search from load() to its envelope.

    0 a completed search, with or without results; 1 usage; 2 an empty corpus or
    filters that leave nothing; 3 a corpus that can't be read; 5 anything else.
    """
    if not query or not query.strip() or limit < 1:
        return Envelope("usage", USAGE, "usage")
    try:
        try:
            docs = load()
            if docs.isEmpty():
                return Envelope(FILTERED_EMPTY, EMPTY, EMPTY_CORPUS)
        except (AnalysisException, OSError):
            return Envelope("unreadable", UNREADABLE, "unreadable-corpus")
        # the filters are looked at only where they were given
        if filters is not None:
            docs = docs.where(filters)
            if docs.isEmpty():
                return Envelope(FILTERED_EMPTY, EMPTY, FILTERS_EXCLUDE_ALL)
        rows = search(docs, query, limit, fields, explain).orderBy("rank").collect()
        return Envelope("search", OK, None, [r.asDict() for r in rows])
    except Exception as error:  # the envelope is the error channel
        return Envelope("error", INTERNAL, str(error))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON string, for a text sink."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
