"""A training-data pipeline of four stages over ``documents``.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns where each piece of a document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, langid, ngram_join, packing
from vellumine.plans.durable import discard, materialise
from vellumine.plans.workers import share_code
from vellumine.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that score less than held-out labelled ones.

    Null and empty texts have no letter.  Where no document is labelled, all with
    a letter are kept.  Rows that repeat are kept or rejected alike; an empty
    table gives an empty one.
    """
    share_code(spark)
    net = langid.fit_language(docs)
    if net is None:
        return docs.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    return langid.keep_languages(docs, net, langid.least_score(docs, net))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates.

    Texts without words are nobody's duplicates; rows with a null id stay; of
    rows that repeat a doc_id all or none stay; an empty table gives an empty one.
    """
    share_code(spark)
    return ngram_join.near_duplicates(docs, width=5, threshold=0.8)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item.

    Null, empty and wordless texts hold none; items without words have none; rows
    that repeat stay or go alike; empty tables drop nothing.
    """
    share_code(spark)
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence.

    Null and empty texts are one end token; rows that repeat are documents of
    their own; an empty table gives an empty one.
    """
    share_code(spark)
    return packing.pack_documents(docs, capacity=1024)


STAGES = [("language_id", identify_language), ("ngram_jaccard", join_near_duplicates), ("decontaminate", remove_benchmarks), ("pack", pack_sequences)]

#: Language identification and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, read = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            written: list[str] = []
            docs = materialise(docs, written)
            # what this stage has read is not read again
            discard(spark, read)
            read = written
    return docs
