"""Scoring with a Katz backoff n-gram model of any order.

    P(w | h) = d(c) c(h w) / c(h)      if h w was seen in training
             = alpha(h) P(w | h')      else, where h' is h without its first word

d are the Good-Turing discounts of the level (its number of words), alpha(h)
makes each context sum to exactly one over the vocabulary and one class for all
unknown words.  P(w) without a context is the Good-Turing discounted unigram
distribution, whose missing mass is that class.  Contexts reach over the start
of a text as start tokens, so every token has an n-gram at every level.

Nothing of the model is broadcast, for it grows with the corpus.  Documents are
gathered in batches of about ``BATCH_TOKENS`` tokens, and each batch asks the
partitions of the count tables once for each distinct word or n-gram it holds:
sorted 64-bit hashes go out in one row per batch and partition, along with the
batch's own training counts, and counts come back in the same order.  So
training and look-up share one exchange, and words as frequent as may be cost a
batch one entry.  Twice the order exchanges in all:

1. words to partitions; total counts back
2. for each level from two, n-grams to partitions; total counts back, and to one
   batch the task of adding the n-gram to its context
3. for each level from two, answers to their batches and sums per context to
   partitions; backoff weights back.  The sums hold probabilities of the level
   below, whose backoff weights come first
4. answers to their batches, which add up the scores of their documents

How often a context was seen is the count of its own words, so the third step is
about two kinds of contexts alone: those that stand in a text that is held out,
for a text of the training never backs off, and those seen over ``DISCOUNTED``
times, which may lack a discount.  The answers to the n-grams tell which
contexts held-out texts have.

A partition is a range of hashes, so what a batch sorts is dealt as it stands.
Counts and backoff weights are written to the shared folder by partition and
batch, which is how the batches read them; tables by n-gram are kept on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.llm.packed import dump, gaps, keys, load
from vellumine.plans.durable import materialise

BATCH_TOKENS = 1_000_000
#: Tokens per partition of the count tables.
PART_TOKENS = 2_000_000
#: Counts above this are not discounted.
DISCOUNTED = 5

_END, _START = (tokens.mix(np.array([x], dtype=np.uint64)) for x in (0xE0D0F5E2, 0x57A27000))
_ROW = "kind string, part long, batch long, payload binary, stats array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["kind", "part", "batch", "payload", "stats"])


@dataclass
class _Batch:
    """Documents as indices of distinct words; words are in order of frequency."""

    doc_ids: np.ndarray
    known: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, payload: pa.Buffer) -> _Batch:
        return cls(*load(payload))

    def levels(self, order: int) -> list[_Level]:
        """The n-grams of levels 2 to order, shortest first."""
        first = np.cumsum(self.sizes) - self.sizes
        names, place = self.words, self.tokens.astype(np.int64)
        out = []
        for _ in range(2, order + 1):
            contexts = np.concatenate([names, _START])
            context = np.empty(len(place), dtype=np.int64)
            context[1:] = place[:-1]
            context[first] = len(names)
            keys, above = np.unique(context << 32 | self.tokens, return_inverse=True)
            lower = np.empty(len(keys), dtype=np.int64)
            lower[above] = place
            with np.errstate(over="ignore"):
                names = tokens.mix(contexts[keys >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.words[keys & 0xFFFFFFFF])
            place = above
            out.append(_Level(contexts, keys, names, place, lower, np.argsort(names)))
        return out

    def trained(self, place: np.ndarray, n: int) -> np.ndarray:
        """Training counts of n-grams, from each token's place among them."""
        return np.bincount(place, weights=np.repeat(self.held == 0, self.sizes), minlength=n).astype(np.uint32)

    def outside(self, place: np.ndarray, n: int) -> np.ndarray:
        """Which n-grams stand in a text that is held out."""
        out = np.zeros(n, dtype=np.uint8)
        out[place[np.repeat(self.held != 0, self.sizes)]] = 1
        return out


@dataclass
class _Level:
    """The distinct n-grams of one length in a batch.

    ``contexts`` are the hashes of the n-grams one word shorter, with that of the
    start of a text last; ``keys`` are (context, word) indices, ``names`` the
    hashes of the n-grams, ``place`` that of each token among them, ``lower``
    that of each without its first word among those of the level below, and
    ``order`` sorts the names.
    """

    contexts: np.ndarray
    keys: np.ndarray
    names: np.ndarray
    place: np.ndarray
    lower: np.ndarray
    order: np.ndarray

    @property
    def context(self) -> np.ndarray:
        return self.keys >> 32


def _deal(hashes: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The runs of sorted hashes that belong to each partition."""
    # the upper halves are enough to part by, and products of halves fit
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:]) if a < b]


def _tokenise(size_of_batch: int):
    def run(batches):
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def flush():
            doc_ids, known, out, sizes, hashes = (np.concatenate(x) for x in zip(*held))
            words, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            train = np.bincount(inverse, weights=np.repeat(out == 0, sizes), minlength=len(words)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order))
            return _rows([("docs", -1, base + number, dump(doc_ids, known, out, sizes, rank[inverse], words[order], train[order]), [len(hashes)])])

        for batch in tokens.parts(batches, "text"):
            data, rows = tokens.utf8(batch.column("text"))
            words, _, _, first = tokens.word_hashes(data, rows, tokens.SPACED)
            sizes = np.diff(first)
            hashes = np.empty(len(words) + len(sizes), dtype=np.uint64)
            hashes[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
            hashes[first[1:] + np.arange(len(sizes))] = _END
            ids = batch.column("doc_id")
            held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(batch.column("held_out")).astype(np.uint8), sizes + 1, hashes))
            size += len(hashes)
            if size >= size_of_batch:
                yield flush()
                held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def _ask_words(parts: int):
    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column("batch").to_pylist(), batch.column("payload")):
                b = _Batch.of(payload.as_buffer())
                order = np.argsort(b.words)
                names, train, outside = b.words[order], b.train[order].astype(np.uint32), b.outside(b.tokens, len(order))[order]
                yield _rows([("ask", p, number, dump(gaps(names[x]), train[x], outside[x]), None) for p, x in _deal(names, parts)])

    return run


def _ask_grams(parts: int, level: int):
    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column("batch").to_pylist(), batch.column("payload")):
                b = _Batch.of(payload.as_buffer())
                grams = b.levels(level)[-1]
                n = len(grams.keys)
                names, train, outside = grams.names[grams.order], b.trained(grams.place, n)[grams.order], b.outside(grams.place, n)[grams.order]
                yield _rows([("ask", p, number, dump(gaps(names[x]), train[x], outside[x]), None) for p, x in _deal(names, parts)])

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, list[int], list[np.ndarray], list[list[np.ndarray]]]:
    """The distinct keys of a partition, and per asking batch the places of its keys."""
    table = table.sort_by("batch")
    asked = [load(p.as_buffer()) for p in table.column("payload")]
    distinct, place = np.unique(np.concatenate([keys(a[0]) for a in asked]), return_inverse=True)
    places = np.split(place, np.cumsum([len(a[0]) for a in asked])[:-1])
    return distinct, table.column("batch").to_pylist(), places, [a[1:] for a in asked]


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()


#: Bits of an answer beside the count: the batch is to add the key to its context; a held-out text has the key.
_OWN, _OUTSIDE, _BITS = 1, 2, 2


def _answer(keep: bool):
    """Sum counts per key; answer with counts and the two bits, the first of them to the first batch that trained on the key."""

    def run(key, table):
        names, numbers, places, asked = _merged(table)
        total, outside = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        for place, (train, held) in zip(places, asked):
            total[place] += train
            outside[place] |= held > 0
        free, out = total > 0, []
        part = key[0].as_py()
        both = total << _BITS | outside * _OUTSIDE
        for number, place, (train, _) in zip(numbers, places, asked):
            own = free[place] & (train > 0)
            out.append(("answer", part, number, dump(both[place] | own * _OWN), None))
            free[place[own]] = False
        seen = total > 0
        out.append(("counts", part, -1, dump(gaps(names[seen]), total[seen]) if keep else None, [int(total.sum()), int(seen.sum()), *_count_of_counts(total)]))
        return pa.Table.from_batches([_rows(out)])

    return run


@dataclass
class Discounts:
    """Good-Turing discounts d(c), from counts of counts 1 to ``DISCOUNTED`` + 1."""

    ratios: np.ndarray

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        k = DISCOUNTED
        ratios = np.ones(k + 1)
        last = (k + 1) * n[k] / n[0] if n[0] else 1.0
        for r in range(1, k + 1):
            value = (((r + 1) * n[r] / (r * n[r - 1])) - last) / (1 - last) if n[r - 1] and last < 1 else 0.0
            ratios[r] = value
        if not ((ratios[1:] > 0) & (ratios[1:] < 1)).all():
            # counts of counts too few for Good-Turing: absolute discounting instead
            ratios[1:] = 1 - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5) / np.arange(1, k + 1)
        return cls(ratios)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > DISCOUNTED, 1.0, self.ratios[np.minimum(counts, DISCOUNTED)])


@dataclass
class Model:
    """What all batches need to know: a few numbers; discounts of levels from two."""

    parts: int
    total: int
    distinct: int
    word_discounts: Discounts
    discounts: list[Discounts]
    unknown: float
    scale: float

    @classmethod
    def of(cls, parts: int, words: list[int], grams: list[list[int]]) -> Model:
        total, distinct, *n = words
        d = Discounts.of(n)
        left = sum(r * n[r - 1] * (1 - d.ratios[r]) for r in range(1, DISCOUNTED + 1))
        scale = 1 / total if left and total else 1 / (total + 1)
        return cls(parts, total, distinct, d, [Discounts.of(n[2:]) for n in grams], left / total if left and total else 1 / (total + 1), scale)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w), of unknown words that of their class."""
        return np.where(counts > 0, self.word_discounts(counts) * counts * self.scale, self.unknown)


def _of_batch(table: pa.Table) -> tuple[_Batch, dict[str, list[pa.Buffer]]]:
    """The documents of a batch, and the answers to it by kind, in order of partitions."""
    table = table.sort_by("part")
    by: dict[str, list[pa.Buffer]] = {}
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
        by.setdefault(kind, []).append(payload.as_buffer())
    return _Batch.of(by.pop("docs")[0]), by


def _answered(order: np.ndarray, answers: list[pa.Buffer]) -> list[np.ndarray]:
    """Answers of all partitions to sorted names, in the names' own order."""
    out = []
    for columns in zip(*map(load, answers)):
        joined = np.concatenate(columns)
        column = np.empty(len(joined), dtype=joined.dtype)
        column[order] = joined
        out.append(column)
    return out


class _Known:
    """What a batch knows of its words and n-grams so far."""

    def __init__(self, batch: _Batch, by: dict[str, list[pa.Buffer]], levels: int):
        self.batch, self.by = batch, by
        self.levels = batch.levels(levels)
        #: Per level, from one on, the answers to its n-grams.
        self.answers = [_answered(np.argsort(batch.words), by.pop("words"))[0]]
        for level, grams in enumerate(self.levels, 2):
            if f"grams{level}" in by:
                self.answers.append(_answered(grams.order, by.pop(f"grams{level}"))[0])

    def seen(self, level: int) -> np.ndarray:
        """How often the contexts of a level were followed: the counts of their words; of the start, those of the end."""
        last = self.batch.words == _END
        return np.append(self.answers[level - 2] >> _BITS, self.answers[0][last] >> _BITS)

    def outside(self, level: int) -> np.ndarray:
        """Which contexts of a level a held-out text may have."""
        return np.append(self.answers[level - 2] & _OUTSIDE > 0, True)

    def asked(self, level: int) -> np.ndarray:
        """Sorted places of the contexts of a level that are dealt with; the others back off nowhere and have discounts."""
        some = np.flatnonzero(self.outside(level) | (self.seen(level) > DISCOUNTED))
        return some[np.argsort(self.levels[level - 2].contexts[some])]

    def weights(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight, where one is needed, and denominator of each context."""
        places, below = self.asked(level), self.seen(level)
        alpha = np.ones(len(below))
        found, extra = _answered(np.arange(len(places)), self.by.pop(f"contexts{level}"))
        alpha[places] = found
        below[places] += extra
        return alpha, below

    def probabilities(self, model: Model, level: int, weights: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the n-grams of a level, each given its context."""
        p = model.unigram(self.answers[0] >> _BITS)
        for k in range(2, level + 1):
            grams, (alpha, below) = self.levels[k - 2], weights[k]
            count = self.answers[k - 1] >> _BITS
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(count > 0, model.discounts[k - 2](count) * count / below[grams.context], alpha[grams.context] * p[grams.lower])
        return p


def _ask_contexts(model: Model, level: int):
    """Per context the sums over those n-grams that this batch is to add, and whether it backs off there.

    Of contexts that no held-out text has, only whether a count is low.
    """

    def run(key, table):
        batch, by = _of_batch(table)
        known = _Known(batch, by, level)
        grams, answer = known.levels[-1], known.answers[-1]
        lower = known.probabilities(model, level - 1, {k: known.weights(k) for k in range(2, level)})
        own = answer & _OWN > 0
        context, count, p = grams.context[own], (answer >> _BITS)[own], lower[grams.lower[own]]
        n = len(grams.contexts)
        sums = [np.bincount(context[count == r], minlength=n).astype(np.uint32) for r in range(1, DISCOUNTED + 1)]
        sums.append(np.bincount(context, weights=np.where(count > DISCOUNTED, count, 0), minlength=n).astype(np.int64))
        sums.append(np.bincount(context, weights=p, minlength=n))
        low = (sum(sums[:DISCOUNTED]) > 0).astype(np.uint8)
        backs = np.zeros(n, dtype=np.uint8)
        backs[grams.context[answer >> _BITS == 0]] = 1
        places = known.asked(level)
        outside = known.outside(level)[places]
        names, columns = grams.contexts[places], [*(np.where(outside, x[places], x.dtype.type(0)) for x in sums), low[places], backs[places]]
        return pa.Table.from_batches([_rows([("ask", p, key[0].as_py(), dump(gaps(names[x]), *(c[x] for c in columns)), None) for p, x in _deal(names, model.parts)])])

    return run


def _back_off(model: Model, level: int, keep: bool):
    """Backoff weight of each context, to the batches that back off there, and whether one more count is set aside."""
    r = np.arange(1, DISCOUNTED + 1)
    ratios = model.discounts[level - 2].ratios[1:]

    def run(key, table):
        names, numbers, places, asked = _merged(table)
        sums, low = np.zeros((DISCOUNTED + 2, len(names))), np.zeros(len(names), dtype=bool)
        for place, (*columns, some, _) in zip(places, asked):
            for s, column in zip(sums, columns):
                s[place] += column
            low[place] |= some > 0
        seen = (sums[:DISCOUNTED] * r[:, None]).sum(axis=0) + sums[DISCOUNTED]
        left = (sums[:DISCOUNTED] * (r * (1 - ratios))[:, None]).sum(axis=0)
        # a context of high counts alone has no discount: one more count is set aside
        extra = ~low
        below = seen + extra
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(seen > 0, np.where(extra, 1.0, left) / below / (1 - sums[DISCOUNTED + 1]), 1.0)
        part = key[0].as_py()
        out = [("answer", part, number, dump(np.where(columns[-1] > 0, alpha[place], 1.0), extra[place].astype(np.uint8)), None) for number, place, columns in zip(numbers, places, asked)]
        if keep:
            out.append(("backoff", part, -1, dump(gaps(names[seen > 0]), alpha[seen > 0], below[seen > 0]), None))
        return pa.Table.from_batches([_rows(out)])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    order = len(model.discounts) + 1

    def run(key, table):
        batch, by = _of_batch(table)
        known = _Known(batch, by, order)
        p = known.probabilities(model, order, {k: known.weights(k) for k in range(2, order + 1)})
        place = known.levels[-1].place if known.levels else batch.tokens
        counts = known.answers[0] >> _BITS
        first = np.cumsum(batch.sizes) - batch.sizes
        base = np.log10((counts + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
        sums = [np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64)[batch.tokens], base[batch.tokens], np.log10(p)[place])]
        n = len(first)
        columns = [pa.array(batch.doc_ids, mask=batch.known == 0), pa.array(batch.held.astype(bool)), pa.array(batch.sizes), pa.array(sums[0]), pa.array(np.full(n, model.total)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return run


def _totals(answers: DataFrame) -> list[int]:
    rows = answers.where("kind = 'counts'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    return [r["n"] for r in rows] or [0] * (DISCOUNTED + 3)


def katz_scores(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", order: int = 2, model: str | None = None) -> DataFrame:
    """Log10 probabilities of whole texts; learns from rows where held_out is false.

    ``order`` is the length of the longest n-grams; of one, nothing has a context.
    Counts and backoff weights stand in tables by partition and batch while the
    texts are scored.  Where ``model`` names a folder, tables of the whole model
    are kept there besides, by level and partition: sorted n-gram hashes with
    their counts (``counts``), and the backoff weights and denominators of all
    contexts that a held-out text has (``backoff``).

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    one row per row of docs.  Words are runs of anything but white space, A-Z
    lowered; every text ends with one end token.  ``base_score`` is that of
    add-0.1 unigrams, with one count for all unknown words.

    A null text is empty and so is its end token alone; a null id is kept, and a
    null ``held_out`` counts as false; repeated rows count each; extra columns
    are ignored; an empty table gives an empty one.  Without training rows every
    token is of the unknown class, whose probability is then one.
    """
    if order < 1:
        raise ValueError(f"order is {order}, not one or more")
    keep = model is not None
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    batches = materialise(rows.mapInArrow(_tokenise(BATCH_TOKENS), _ROW), partition_by=["kind"])
    n_tokens = batches.agg(F.sum(F.element_at("stats", 1))).first()[0] or 0
    parts = max(1, -(-n_tokens // PART_TOKENS))
    docs_of = batches.select(F.lit("docs").alias("kind"), "part", "batch", "payload")
    known: dict[str, DataFrame] = {}

    def answered(table: DataFrame, kind: str, level: int) -> DataFrame:
        """Writes a table, and keeps its answers as those of a kind."""
        table = materialise(table, partition_by=["kind"])
        known[kind] = table.where("kind = 'answer'").select(F.lit(kind).alias("kind"), "part", "batch", "payload")
        if keep:
            for name in ("counts", "backoff"):
                if not (part := table.where(F.col("kind") == name).select("part", "payload")).isEmpty():
                    part.write.parquet(f"{model}/{name}/level={level}")
        return table

    words = answered(docs_of.mapInArrow(_ask_words(parts), _ROW).groupBy("part").applyInArrow(_answer(keep), _ROW), "words", 1)
    counted = []
    for level in range(2, order + 1):
        counted.append(_totals(answered(docs_of.mapInArrow(_ask_grams(parts, level), _ROW).groupBy("part").applyInArrow(_answer(keep), _ROW), f"grams{level}", level)))
    numbers = Model.of(parts, _totals(words), counted)

    def gathered(*kinds: str):
        rows = docs_of
        for kind in kinds:
            rows = rows.union(known[kind])
        return rows.groupBy("batch")

    for level in range(2, order + 1):
        needed = [x for k in range(2, level) for x in (f"grams{k}", f"contexts{k}")]
        asked = gathered("words", *needed, f"grams{level}").applyInArrow(_ask_contexts(numbers, level), _ROW)
        answered(asked.groupBy("part").applyInArrow(_back_off(numbers, level, keep), _ROW), f"contexts{level}", level)
    return gathered(*known).applyInArrow(_score(numbers), _SCORES)
