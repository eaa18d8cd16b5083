"""Posting lists of character trigrams, so that a search reads few blocks of texts.

Entries are dealt into blocks, a folder of files each.  A posting says that some
text of a block holds three characters in a row, that one of its identifiers is
so and so, or that a metadata field has a value.  A term's trigrams are looked
up and intersected; what is left is a superset of the blocks that hold the term,
and the grep of ``search`` decides.  Terms of fewer than three characters, and
terms whose trigrams are everywhere, prune nothing, and lose nothing.

Additions make blocks of their own, so an index grows without a look at what it
holds.  A batch of entries that is added twice is the caller's to avoid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.search import Fields, matches, terms_of

#: Folders of postings; a term's lookup reads as many as it has trigrams, at most.
BUCKETS = 64


def _grams(low: Column) -> Column:
    """All runs of three characters of a text, each once; in one pass."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _keys(fields: Fields) -> Column:
    """What an entry is found by: ``g`` and a trigram, ``i`` and its identifier, ``m`` and a value of its metadata."""
    named = [F.concat(F.lit("i"), F.lower(F.col(fields.id).cast("string"))), *[F.concat(F.lit("m"), F.lower(F.col(m).cast("string"))) for m in fields.metadata]]
    return F.concat(F.transform(_grams(F.lower(F.coalesce(fields.text, F.lit("")))), lambda g: F.concat(F.lit("g"), g)), F.array_compact(F.array(*named)))


@dataclass(frozen=True)
class GramIndex:
    """An index in a folder: ``texts`` and ``blocks`` by addition and block, ``postings`` by bucket and addition."""

    spark: SparkSession
    path: str
    fields: Fields = Fields()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame, addition: int, block: Column | None = None, blocks: int = 256) -> None:
        """Add entries as blocks of their own, under the number of the addition.

        The number names the folders, so one that is added again after a failure is
        written over.  ``block`` says which entries stand together, else a hash of the identifier.
        """
        number = F.pmod(F.xxhash64(self.fields.id), F.lit(blocks)) if block is None else block
        if docs.isEmpty():
            return
        dealt = docs.withColumn("block", F.concat_ws("_", F.lit(f"b{addition}"), number.cast("string")))
        # in order of identifiers, and with a filter on them in each row group, for reads of single entries
        ordered = dealt.repartition("block").sortWithinPartitions("block", self.fields.id)
        ordered.write.option(f"parquet.bloom.filter.enabled#{self.fields.id}", "true").parquet(f"{self.path}/texts/addition={addition}", mode="overwrite", partitionBy=["block"])
        held = self.spark.read.option("basePath", f"{self.path}/texts").parquet(f"{self.path}/texts/addition={addition}")
        size = F.octet_length(F.coalesce(F.col(self.fields.text), F.lit("")))
        held.groupBy("block").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes")).write.parquet(f"{self.path}/blocks/addition={addition}", mode="overwrite")
        postings = held.select("block", F.explode(_keys(self.fields)).alias("key")).distinct().withColumn("bucket", _bucket(F.col("key")))
        postings.repartition("bucket").sortWithinPartitions("bucket", "key").write.parquet(f"{self.path}/postings/addition={addition}", mode="overwrite", partitionBy=["bucket"])

    def _postings(self, keys: list[str]) -> DataFrame:
        """The postings of some keys, from the buckets that they are in."""
        # computed as they were when the postings were written
        buckets = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(F.col("key"))).distinct().collect()]
        return self._table("postings").where(F.col("bucket").isin(buckets) & F.col("key").isin(keys))

    def candidates(self, query: str) -> DataFrame:
        """``(block)``: every block with an entry that the query may find, and others; a row per block at most."""
        groups = []
        for term in terms_of(query):
            grams = ["g" + term[i : i + 3] for i in range(len(term) - 2)]
            if not grams:
                return self._table("blocks").select("block")
            groups += [[*dict.fromkeys(grams)], ["i" + term], ["m" + term]]
        wanted = sorted({key for keys in groups for key in keys})
        if not wanted:
            return self._table("blocks").select("block").where("false")
        held = self._postings(wanted).groupBy("block").agg(F.collect_set("key").alias("keys"))
        whole = [F.size(F.array_intersect(F.lit(keys), "keys")) == len(keys) for keys in groups]
        fits = whole[0]
        for other in whole[1:]:
            fits = fits | other
        return held.where(fits).select("block")

    def matches(self, query: str, flags: DataFrame | None = None) -> DataFrame:
        """What ``search.matches`` finds in all entries, from the candidates' blocks alone."""
        texts = self._table("texts")
        met = texts.join(F.broadcast(self.candidates(query)), "block", "left_semi")
        return matches(met.drop("block", "addition"), query, self.fields, flags)

    def originals(self, found: DataFrame) -> DataFrame:
        """The whole entries that a search found (id, rank), in its order; found is as small as the search's limit.

        Their blocks are looked up by identifier; in these, row groups without one of the identifiers are skipped.
        """
        name = self.fields.id
        ranked = found.select(name, "rank").collect()
        if not ranked:
            return self._table("texts").drop("block", "addition").withColumn("rank", F.lit(0).cast("long")).where("false")
        blocks = self._postings(sorted({"i" + str(r[name]).lower() for r in ranked})).select("block").distinct()
        texts = self._table("texts").where(F.col(name).isin([r[name] for r in ranked])).join(F.broadcast(blocks), "block", "left_semi")
        places = self.spark.createDataFrame(ranked, found.select(name, "rank").schema)
        return texts.drop("block", "addition").join(F.broadcast(places), name).orderBy("rank")

    def report(self, query: str) -> DataFrame:
        """``(n_blocks, n_bytes, read_blocks, read_bytes)``: what there is, and what the query reads."""
        picked = self.candidates(query).distinct().select(F.col("block").alias("picked"))
        met = self._table("blocks").join(picked, F.col("block") == F.col("picked"), "left")
        read = F.col("picked").isNotNull()
        total = {"n_blocks": F.count("*"), "n_bytes": F.sum("n_bytes"), "read_blocks": F.count_if(read), "read_bytes": F.sum(F.when(read, F.col("n_bytes")).otherwise(0))}
        return met.agg(*[F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in total.items()])
