"""Language identification with a byte convolutional network, in numpy.

Texts are cut into windows of ``WINDOW`` bytes.  Filters of several widths run
over the bytes of a window, each filter's maximum over the window is kept, and
softmax over a linear layer gives the languages.  A text's probabilities are the
mean over all its windows, weighted by their bytes.

A filter of width w is a table of responses per byte and place.  For prediction
the tables of neighbouring places are added up into tables over byte pairs, so
that a width of three or four costs two look-ups a byte instead of four.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.plans.durable import discard, materialise

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled rows of each language that the fit takes at most, by a hash of their id.
SAMPLE_ROWS = 400
#: Windows of each language that the fit takes at most, spread over its texts.
SAMPLE_WINDOWS = 3000
#: Share of held-out labelled rows that may score less, and how far from chance to their score the limit lies.
LIMIT_SHARE, LIMIT_PART = 0.001, 0.75
#: Parts that a range of scores is counted in.
_PARTS = 1024
_RANGE = 1 << 40
STEPS, BATCH, RATE = 500, 128, 0.02

_LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """Filters per width: (width, 256, filters); a bias each; and the output layer."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = {w: (rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.standard_normal((FILTERS * len(WIDTHS), len(labels))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), *self.bias.values(), self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        pooled, at = [], {}
        for w in WIDTHS:
            span = WINDOW - w + 1
            response = sum(self.filters[w][j][x[:, j : j + span]] for j in range(w))
            at[w] = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, at[w][:, None, :], axis=1)[:, 0] + self.bias[w])
        return np.concatenate(pooled, axis=1), at

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on the cross-entropy; the maxima pass the gradient on to their bytes."""
        rng = np.random.default_rng(seed)
        weights = self._parameters()
        first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(x), BATCH)
            xs = x[rows]
            pooled, at = self._pooled(xs)
            hidden = np.tanh(pooled)
            wrong = _softmax(hidden @ self.out + self.out_bias)
            wrong[np.arange(BATCH), y[rows]] -= 1
            wrong /= BATCH
            back = (wrong @ self.out.T) * (1 - hidden**2)
            slopes: list[np.ndarray] = []
            for k, w in enumerate(WIDTHS):
                part, slope = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.filters[w])
                for j in range(w):
                    np.add.at(slope[j], (np.take_along_axis(xs, at[w] + j, axis=1), np.arange(FILTERS)[None, :]), part)
                slopes.append(slope)
            slopes += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            slopes += [hidden.T @ wrong, wrong.sum(axis=0)]
            rate = RATE * (1 - step / (STEPS + 1))
            for p, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width the look-ups: (offset, table over byte pairs or bytes)."""
        out = {}
        for w in WIDTHS:
            parts = []
            for j in range(0, w - 1, 2):
                pair = self.filters[w][j][:, None, :] + self.filters[w][j + 1][None, :, :]
                parts.append((j, pair.reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, self.filters[w][w - 1]))
            out[w] = parts
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all bytes of each row: (bytes, row, weight); the last is filled with spaces."""
    sizes = np.diff(rows)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = rows[:-1][row] + within * WINDOW
    weight = np.minimum(WINDOW, rows[1:][row] - start)
    if len(row) and (weight == WINDOW).all() and len(data) == len(row) * WINDOW:
        return data.reshape(-1, WINDOW), row, weight
    at = start[:, None] + np.arange(WINDOW)
    padded = np.append(data, np.uint8(32))
    return padded[np.where(np.arange(WINDOW) < weight[:, None], at, len(data))], row, weight


class Predictor:
    def __init__(self, net: ByteNet):
        self.net, self.tables = net, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities per window, a few hundred windows at a time."""
        out = [self._some(x[i : i + 256]) for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros((0, len(self.net.labels)), np.float32)

    def _some(self, x: np.ndarray) -> np.ndarray:
        wide = x.astype(np.int32)
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        pooled = []
        for w in WIDTHS:
            span = WINDOW - w + 1
            response = None
            for offset, table in self.tables[w]:
                codes = (pairs if len(table) == 65536 else wide)[:, offset : offset + span]
                part = np.take(table, codes, axis=0)
                response = part if response is None else np.add(response, part, out=response)
            pooled.append(response.max(axis=1) + self.net.bias[w])
        return _softmax(np.tanh(np.concatenate(pooled, axis=1)) @ self.net.out + self.net.out_bias)

    def rows(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probabilities per row; zeros for rows without bytes."""
        out = np.zeros((len(rows) - 1, len(self.net.labels)))
        x, row, weight = windows(data, rows)
        if len(row):
            np.add.at(out, row, self.windows(x) * weight[:, None])
            out /= np.maximum(np.diff(rows), 1)[:, None]
        return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from the fit: crc32 of its id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _cut(batches):
    """Windows of labelled texts: of each language and task those with the smallest marks, up to the sample's number."""
    best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in tokens.parts(batches, "text", 1 << 20):
        x, row, weight = windows(*tokens.utf8(batch.column("text")))
        # a mark is a hash of the row's and of the place of the window in it
        place = np.arange(len(row)) - np.searchsorted(row, row)
        with np.errstate(over="ignore"):
            mark = tokens.mix(np.asarray(batch.column("mark")).astype(np.int64).view(np.uint64)[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)[row]
        for lang in set(langs[weight > 0]):
            own = (langs == lang) & (weight > 0)
            marks, bytes_ = (np.concatenate(c) for c in zip(best.get(lang, (mark[:0], x[:0])), (mark[own], x[own])))
            few = np.argsort(marks, kind="stable")[:SAMPLE_WINDOWS]
            best[lang] = marks[few], bytes_[few]
    for lang, (marks, bytes_) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(marks)), pa.array(marks.view(np.int64)), pa.array([b.tobytes() for b in bytes_], pa.binary())], names=["lang", "mark", "bytes"])


def fit_language(docs: DataFrame) -> ByteNet | None:
    """Fit on a bounded sample of labelled rows; None if no row is labelled.

    Every lang value is learned, however rare.

    At most ``SAMPLE_ROWS`` rows of a language, chosen by a hash of the id over
    the whole table, and ``SAMPLE_WINDOWS`` of their windows, chosen by a hash too.
    Windows are cut in tasks, so the driver gets at most ``SAMPLE_WINDOWS`` times
    ``WINDOW`` bytes of a language, however long its texts are.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # a share of each language by a hash of the id, so that no task ranks a whole language
    share = F.least(F.lit(_RANGE), F.floor(F.lit(4 * SAMPLE_ROWS) * F.lit(float(_RANGE)) / F.count("*")).cast("long") + 1)
    shares = usable.groupBy("lang").agg(share.alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    few = usable.select("doc_id", "lang", place.alias("place")).join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share"))
    ids = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_ROWS).select("doc_id", "lang")
    rows = usable.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).select("lang", F.xxhash64("doc_id", "text").alias("mark"), "text")
    cut = rows.mapInArrow(_cut, "lang string, mark long, bytes binary")
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "bytes"))).where(F.col("k") <= SAMPLE_WINDOWS)
    sample = ranked.select("lang", "mark", "bytes").toPandas().sort_values(["lang", "mark", "bytes"])
    labels = sorted(r["lang"] for r in shares.select("lang").collect())
    if not labels:
        return None
    xs, ys = [], []
    for k, lang in enumerate(labels):
        own = sample.loc[sample["lang"] == lang, "bytes"]
        if len(own):
            xs.append(np.frombuffer(b"".join(own), dtype=np.uint8).reshape(-1, WINDOW))
            ys.append(np.full(len(own), k))
    net = ByteNet(labels)
    if xs:
        # languages count alike: each is drawn up to the same number of windows
        most = max(map(len, xs))
        xs = [x[np.resize(np.arange(len(x)), most)] for x in xs]
        ys = [np.resize(y, most) for y in ys]
        net.fit(np.concatenate(xs).astype(np.int64), np.concatenate(ys))
    return net


def _named(predictor: Predictor | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lettered = [bool(t and _LETTER.search(t)) for t in column.to_pylist()]
    if not predictor:
        return ["und"] * len(lettered), np.zeros(len(lettered))
    p = predictor.rows(*tokens.utf8(column))
    names = [predictor.net.labels[best] if ok else "und" for best, ok in zip(p.argmax(axis=1), lettered)]
    return names, np.clip(np.where(lettered, p.max(axis=1), 0.0), 0.0, 1.0)


def _predict(net):
    def run(batches):
        predictor = Predictor(net.value) if net.value else None
        for batch in tokens.parts(batches, "text", 1 << 20):
            names, scores = _named(predictor, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keep(net, least: float):
    def run(batches):
        predictor = Predictor(net.value) if net.value else None
        for batch in tokens.parts(batches, "text", 1 << 20):
            names, scores = _named(predictor, batch.column("text"))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return run


def _right(net):
    def run(batches):
        predictor = Predictor(net.value)
        for batch in tokens.parts(batches, "text", 1 << 20):
            names, scores = _named(predictor, batch.column("text"))
            right = [n == lang for n, lang in zip(names, batch.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(scores[np.array(right, dtype=bool)], pa.float64())], names=["score"])

    return run


def _low_quantile(scores: DataFrame, share: float) -> tuple[int, float]:
    """The number of scores, from 0 to 1, and their exact quantile, interpolated between its neighbours.

    The part of the range that holds the wanted rank is counted again in finer
    parts until one value is left, so that no task or driver sees all scores.
    """
    score, low, high, number = F.col("score"), 0.0, 1.0, None
    while number is None or low < high:
        part = F.least(F.lit(_PARTS - 1), F.floor((score - low) / (high - low) * _PARTS))
        parts = scores.where(score.between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).orderBy("part").collect()
        if number is None:
            number = sum(p["n"] for p in parts)
            if not number:
                return 0, 0.0
            place = share * (number - 1)
            rank = left = int(place)
        for p in parts:
            if left < p["n"]:
                low, high = p["low"], p["high"]
                break
            left -= p["n"]
    upto, above = scores.agg(F.count(F.when(score <= low, 1)), F.min(F.when(score > low, score))).first()
    return number, low if upto > rank + 1 or above is None else low + (place - rank) * (above - low)


def least_score(docs: DataFrame, net: ByteNet) -> float:
    """A limit under the scores of nearly all held-out labelled rows that are named rightly.

    All of them are scored.  The limit lies between chance and the score that all
    but ``LIMIT_SHARE`` of them reach, so that few rows set it safely; zero if there
    are none of them.  Where they are too few to show that share, the gap to a
    score of one is carried on as that of an exponential tail, which grows with
    the logarithm of the number.
    """
    if len(net.labels) < 2:
        return 0.0
    spark, written = docs.sparkSession, []
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out(F.col("doc_id"))).select("lang", "text")
    number, quantile = _low_quantile(materialise(usable.mapInArrow(_right(spark.sparkContext.broadcast(net)), "score double"), written), LIMIT_SHARE)
    discard(spark, written)
    if not number:
        return 0.0
    chance = 1 / len(net.labels)
    tail = max(1.0, np.log(1 / LIMIT_SHARE) / np.log(1 + number))
    reached = 1 - tail * (1 - quantile)
    return float(chance + LIMIT_PART * max(0.0, reached - chance))


def keep_languages(docs: DataFrame, net: ByteNet | None, least: float) -> DataFrame:
    """Rows of docs, with all their columns, whose language is known with a score of least or more.

    Null, empty and letterless texts go; a score of exactly least stays; rows
    that repeat stay or go alike; an empty table gives an empty one.
    """
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(net), least), docs.schema)


def predict_language(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of docs.

    The whole text is read.  ``und`` with score 0 stands for texts that are null,
    empty or without a letter, and for all where nothing was labelled.  Of
    languages equally likely the first by name is told.  A null
    id is not held out; repeated rows are predicted alike; extra columns are
    ignored; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, held_out boolean, lang_pred string, score double")
