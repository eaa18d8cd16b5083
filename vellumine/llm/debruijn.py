"""Substring dedup by compaction of a De Bruijn graph of token k-mers.

A k-mer, k consecutive words of a document, is an edge between the runs of k - 1
words that it starts and ends with; a document is a walk.  An edge that is walked
more than once is a repeat.  Repeats are found without a row per edge:

1. Each k-mer has an anchor, the smallest hash among its short inner runs.  A
   walk is cut where the anchor's place changes, so that neighbouring edges of
   one anchor are one row, a path (the graph's super-k-mers).  Equal k-mers have
   equal anchors at equal places, so all occurrences of an edge meet under its
   anchor, and one place in some eight is an anchor.
2. Anchors are counted; paths under one that occurs once hold no repeat.
3. An anchor under which all walks take one and the same path does not branch: the
   path is compact, and its occurrences are copies of the first one as a whole.
   Where several paths meet, each path's later occurrences are copies of its
   first one, and the first ones are opened into their edges, which are compared
   edge by edge.
4. Copies are joined with their source.  What copies one source at one distance
   without a gap is a single span, whose coordinates, in the document and in the
   source, advance together.
5. The words at both coordinates of a span are compared, so that equal hashes of
   different words remove nothing.

Everything is grouped by hashes with partial sums, so one passage in a third of
all documents costs a task a row.  Joins on such keys broadcast the most
frequent of them, of which there are boundedly many; all other keys hold a small
share of the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.plans.durable import discard, materialise, settle
from vellumine.plans.skew import meet

#: Words of the runs among which a k-mer's anchor is chosen.
INNER = 6
#: Spans of a document that are compared together.
SPANS = 10_000

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_PATHS = "anchor long, path long, doc long, tag long, start int, n int"
_PLACE = ("doc", "tag", "start")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Walks:
    """The words of some documents as hashes, one document behind the other."""

    def __init__(self, column: pa.Array, k: int):
        self.k = k
        data, rows = tokens.utf8(column)
        self.words, _, _, self.first = tokens.word_hashes(data, rows, tokens.SPACED, fold=False)
        n = len(self.words)
        row = np.repeat(np.arange(len(column)), np.diff(self.first))
        #: Starts of k-mers that lie in one document, and their documents' numbers.
        starts = np.arange(max(0, n - k + 1))
        self.starts = starts[row[starts] == row[starts + k - 1]] if len(starts) else starts
        self.row = row[self.starts]
        with np.errstate(over="ignore"):
            self._back = _powers(_INVERSE, n + 1)
            self._sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.words * _powers(np.uint64(_BASE), n), dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of runs of words, wherever they stand."""
        with np.errstate(over="ignore"):
            return tokens.mix((self._sums[ends] - self._sums[starts]) * self._back[starts] ^ (ends - starts).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each k-mer: the place of the leftmost smallest hash of its inner runs, and that hash."""
        inner = min(INNER, self.k)
        hashes = tokens.shingle_hashes(self.words, inner)
        width = self.k - inner + 1
        place, reach = np.arange(len(hashes)), 1
        while reach < width:
            # runs of a doubled reach, up to the width; of equal ones the left stays
            step = min(reach, width - reach)
            a, b = place[:-step], place[step:]
            place, reach = np.where(hashes[b] < hashes[a], b, a), reach + step
        place = place[self.starts]
        return place, hashes[place]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first k-mer's start, number of k-mers, and document of each path."""
        if not len(self.starts):
            empty = np.zeros(0, dtype=np.int64)
            return empty.astype(np.uint64), empty, empty, empty
        place, anchor = self.anchors()
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])
        head = np.flatnonzero(new)
        n = np.diff(head, append=len(place))
        return anchor[head], self.starts[head], n, self.row[head]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _rows(anchor: np.ndarray, path: np.ndarray, batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    columns = [_long(anchor), _long(path), batch.column("doc").take(at), batch.column("tag").take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "path", "doc", "tag", "start", "n"])


def _cut(k: int):
    """The paths of documents."""

    def run(batches):
        for batch in tokens.parts(batches, "text"):
            walks = _Walks(batch.column("text"), k)
            anchor, start, n, row = walks.paths()
            yield _rows(anchor, walks.hashes(start, start + n + k - 1), batch, row, start - walks.first[row], n)

    return run


def _open(k: int):
    """The edges of the paths that stand beside each document as ``picked``."""

    def run(batches):
        for batch in tokens.parts(batches, "text"):
            walks = _Walks(batch.column("text"), k)
            picked = batch.column("picked")
            sizes = np.asarray(picked.value_lengths(), dtype=np.int64)
            every = picked.flatten()
            start, n, anchor = (every.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "anchor"))
            row = np.repeat(np.repeat(np.arange(len(picked)), sizes), n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start, n) + within
            whole = at + walks.first[row]
            yield _rows(np.repeat(anchor, n), walks.hashes(whole, whole + k), batch, row, at, np.ones(len(at), dtype=np.int64))

    return run


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in _PLACE])


def _texts(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """``(doc, tag, text)`` of all rows, and of all documents.

    Documents are in order of their ids, a null id first, and of a hash of the
    text where ids repeat; rows that repeat both are one document.
    """
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    repeated = not docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(doc.alias("doc"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("tag"), text.alias("text"))
    return rows, rows.dropDuplicates(["doc", "tag"]) if repeated else rows


def _copies(rows: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences of repeated keys other than the first, each with the place that it copies."""
    met = meet(rows, firsts.where("n_rows > 1").select(*key, "n_rows", "first"), key, "n_rows")
    return met.where(_place() != F.col("first")).select(*_PLACE, "n", F.col("first.doc").alias("of_doc"), F.col("first.tag").alias("of_tag"), F.col("first.start").alias("of_start"))


def _copied(texts: DataFrame, k: int) -> DataFrame:
    """``(doc, tag, start, n, of_doc, of_tag, of_start)``: runs of n k-mers that stand earlier too; a row per path or edge."""
    spark = texts.sparkSession
    old: list[str] = []
    paths = materialise(texts.mapInArrow(_cut(k), _PATHS), old)
    anchors = paths.groupBy("anchor").agg(F.count("*").alias("n_rows"), F.min("path").alias("low"), F.max("path").alias("high"))
    anchors = materialise(anchors.where("n_rows > 1").select("anchor", "n_rows", (F.col("low") != F.col("high")).alias("branches")), old)
    later: list[str] = []
    met = materialise(meet(paths, anchors, ["anchor"], "n_rows").drop("n_rows"), later)
    discard(spark, old)
    firsts = met.groupBy("anchor", "path").agg(F.count("*").alias("n_rows"), F.min(_place()).alias("first"), F.first("n").alias("n"), F.first("branches").alias("branches"))
    firsts = materialise(firsts, later)
    kept: list[str] = []
    copies = materialise(_copies(met.drop("branches"), firsts, ["anchor", "path"]), kept)
    opened = firsts.where("branches").select("first.*", "anchor", "n")
    picked = opened.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("picked"))
    edges = materialise(texts.join(picked, ["doc", "tag"]).mapInArrow(_open(k), _PATHS), later)
    earliest = materialise(edges.groupBy("anchor", "path").agg(F.count("*").alias("n_rows"), F.min(_place()).alias("first")).where("n_rows > 1"), later)
    found = copies.unionByName(materialise(_copies(edges, earliest, ["anchor", "path"]), kept))
    discard(spark, later)
    return found


def _glued(copies: DataFrame, k: int) -> DataFrame:
    """``(doc, tag, start, n_words, of_doc, of_tag, of_start)``: copies of one source at one distance, end to end, as one span."""
    ends = ("doc", "tag", "of_doc", "of_tag", "shift")
    along = Window.partitionBy(*ends).orderBy("start")
    opens = F.coalesce(F.lag(F.col("start") + F.col("n")).over(along) != F.col("start"), F.lit(True)).cast("int")
    runs = copies.withColumn("shift", F.col("start") - F.col("of_start")).withColumn("opens", opens).withColumn("run", F.sum("opens").over(along))
    spans = runs.groupBy(*ends, "run").agg(F.min("start").alias("start"), (F.sum("n") + k - 1).cast("int").alias("n_words"))
    return spans.select("doc", "tag", "start", "n_words", "of_doc", "of_tag", (F.col("start") - F.col("shift")).alias("of_start"))


def _digests(batches):
    """A digest of the words of each span that stands beside a document as ``picked``."""
    for batch in tokens.parts(batches, "text"):
        out = []
        for row, (text, picked) in enumerate(zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("picked").to_pylist())):
            words = text.split()
            out += [(row, x["start"], x["n_words"], hashlib.blake2b(b" ".join(words[x["start"] : x["start"] + x["n_words"]]), digest_size=16).digest()) for x in picked]
        at = pa.array([x[0] for x in out], pa.int64())
        columns = [batch.column("doc").take(at), batch.column("tag").take(at), *(pa.array([x[c] for x in out], kind) for c, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary())))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "start", "n_words", "words"])


def _verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are those at their source's coordinates.

    Both ends are read once for each document, in lists of ``SPANS`` at most, and
    their digests are joined back; many spans may have one source.
    """
    at = ("doc", "tag", "start", "n_words")
    of = ("of_doc", "of_tag", "of_start", "n_words")
    source = spans.select(*[F.col(c).alias(d) for c, d in zip(of, at)])
    ends = spans.select(*at).union(source).distinct()
    lists = ends.join(ends.groupBy("doc", "tag").agg(F.count("*").alias("many")), ["doc", "tag"])
    lists = lists.withColumn("part", F.pmod(F.xxhash64("start", "n_words"), F.ceil(F.col("many") / SPANS)))
    lists = lists.groupBy("doc", "tag", "part").agg(F.collect_list(F.struct("start", "n_words")).alias("picked"))
    read = materialise(texts.join(lists.drop("part"), ["doc", "tag"]).mapInArrow(_digests, "doc long, tag long, start int, n_words int, words binary"))
    own = spans.join(read.withColumnRenamed("words", "own"), list(at))
    sources = source.groupBy(*at).agg(F.count("*").alias("n_rows")).join(read, list(at)).select(*[F.col(d).alias(c) for c, d in zip(of, at)], "n_rows", "words")
    return meet(own, sources, list(of), "n_rows").where("own = words").select(*spans.columns)


def _found(texts: DataFrame, k: int) -> DataFrame:
    spark = texts.sparkSession
    return settle(spark, lambda: _verified(texts, settle(spark, lambda: _glued(_copied(texts, k), k))))


def repeated_spans(docs: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, start, n_words, of_doc_id, of_start)``: spans of k words and more that stand earlier too.

    ``start`` and ``of_start`` count words from 0.  A span is as long as document
    and source go on alike, where the source is the first place of each of its
    k-mers; spans of different sources may overlap by up to k - 1 words.

    Nulls, repeats and empty tables: see ``remove_repeats``.
    """
    _, texts = _texts(docs, id_column, text_column)
    named = [F.when(F.col(c) != -(2**63), F.col(c)).alias(f"{c}_id") for c in ("doc", "of_doc")]
    return _found(texts, k).select(named[0], "start", "n_words", named[1], "of_start")


def _removed(batches):
    """Texts without the words of their spans."""
    for batch in tokens.parts(batches, "text"):
        out = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans")):
            # bytes split at the space and the controls 9 to 13
            words = text.split()
            n = len(words)
            if spans.is_valid:
                change = np.zeros(n + 1, dtype=np.int64)
                start, many = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n_words"))
                np.add.at(change, start, 1)
                np.add.at(change, start + many, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0)]
            out.append((n, n - len(words), b" ".join(words).decode()))
        columns = [batch.column("doc"), *(pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of docs.

    A word goes if it is in a run of k words that also starts earlier: in a
    document of a smaller id, or before in the same one.  Runs are those of the
    input.  ``kept`` has the other words, one space between them.  Words are cut
    at the space and the controls 9 to 13, and are compared unchanged.

    Null texts have no words.  A null id comes before all others; of documents
    that share an id the order is by a hash of the text, and rows that repeat both
    are one document, so each of them gets its result.  Other columns are ignored;
    an empty table gives an empty one.  A document's spans are no more than its
    words, however often they stand elsewhere.
    """
    rows, texts = _texts(docs, id_column, text_column)
    spans = _found(texts, k).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    made = rows.join(spans, ["doc", "tag"], "left").mapInArrow(_removed, "doc long, n_words long, n_removed long, kept string")
    return made.select(F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(made: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of what ``remove_repeats`` kept."""
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
