"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items.  A document's
words are streamed through it; at each word the length of the longest run that
ends there and occurs in an item is known.  A window of ``window`` words occurs
at a word if and only if that length reaches ``window``.

The automaton is built on the driver from about ``SHARD_BYTES`` of benchmark text
and broadcast.  A larger benchmark is dealt into shards by item, of which one at a
time is on the driver and on the executors: the documents are scanned against
each, hits are written by the SHA-256 of their text, and at the end meet the
documents again.  So what is held is bounded, and each shard costs a scan.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.plans.durable import materialise

#: Benchmark text of one automaton, about.
SHARD_BYTES = 4 << 20
#: Moves of a state that are looked through one by one while the automaton grows.
WIDE = 8
#: Texts with hits that may be broadcast; beyond, the join shuffles.
BROADCAST_HITS = 20_000


class _Builder:
    """An automaton that grows word by word, in flat arrays.

    The moves of a state are a chain of (word, target), newest first; a state with
    many has a dictionary of them besides.
    """

    def __init__(self) -> None:
        self.link, self.len, self.head, self.many = array("i"), array("i"), array("i"), array("i")
        self.source, self.word, self.target, self.older = array("i"), array("i"), array("i"), array("i")
        self.wide: dict[int, dict[int, int]] = {}
        self._state(0, -1)

    def _state(self, length: int, link: int) -> int:
        self.len.append(length)
        self.link.append(link)
        self.head.append(-1)
        self.many.append(0)
        return len(self.len) - 1

    def _move(self, p: int, c: int) -> int:
        """The number of the move of state p by word c, or -1."""
        if self.many[p] > WIDE:
            return self.wide[p].get(c, -1)
        t = self.head[p]
        while t >= 0 and self.word[t] != c:
            t = self.older[t]
        return t

    def _chain(self, p: int):
        t = self.head[p]
        while t >= 0:
            yield t
            t = self.older[t]

    def _add(self, p: int, c: int, target: int) -> None:
        t = len(self.word)
        self.source.append(p)
        self.word.append(c)
        self.target.append(target)
        self.older.append(self.head[p])
        self.head[p] = t
        self.many[p] += 1
        if self.many[p] == WIDE + 1:
            self.wide[p] = {self.word[x]: x for x in self._chain(p)}
        elif self.many[p] > WIDE:
            self.wide[p][c] = t

    def _split(self, p: int, c: int, move: int) -> int:
        """The state for the run of p and c alone, where the move's target also stands for longer ones."""
        q = self.target[move]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, self.link[q])
        for t in list(self._chain(q)):
            self._add(clone, self.word[t], self.target[t])
        self.link[q] = clone
        while p >= 0 and (t := self._move(p, c)) >= 0 and self.target[t] == q:
            self.target[t] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        move = self._move(last, c)
        if move >= 0:
            return self._split(last, c, move)
        new = self._state(self.len[last] + 1, 0)
        while last >= 0 and (move := self._move(last, c)) < 0:
            self._add(last, c, new)
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, c, move)
        return new


def _ints(values: np.ndarray) -> array:
    """As an array whose elements Python reads fast."""
    return array("i", np.ascontiguousarray(values, dtype=np.int32).tobytes())


class SuffixAutomaton:
    """All runs of words of several items, with the items in which each occurs; in flat arrays of 4 bytes a number.

    ``moves[s]:moves[s + 1]`` are the moves of state s in order of their words.
    ``held`` and ``short`` name, per state, rows of lists of items: those with a
    window that ends there, and those that are one short window.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, dtype=np.uint64)
        #: Sorted hashes of the item words; a word's id is its place here.
        self.words = words
        items = [(name, np.searchsorted(words, w).tolist()) for name, w in items if len(w)]
        #: Names of the items that have words.
        self.names = [name for name, _ in items]
        grown = _Builder()
        for _, ids in items:
            last = 0
            for c in ids:
                last = grown.extend(last, c)
        source, word, target = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, dtype=np.int32) for x in (grown.source, grown.word, grown.target))
        order = np.lexsort((word, source))
        self.moves = _ints(np.searchsorted(source[order], np.arange(len(grown.len) + 1)))
        self.word, self.target = _ints(word[order]), _ints(target[order])
        self.link, self.len = grown.link, grown.len
        del grown, source, word, target, order
        self._name([ids for _, ids in items])
        #: Shorter runs of known words can't hold a window.
        self.shortest = min([window, *(len(ids) for _, ids in items)])

    def _step(self, state: int, c: int) -> int:
        """The state that a word leads to, or -1."""
        high = self.moves[state + 1]
        at = bisect_left(self.word, c, self.moves[state], high)
        return self.target[at] if at < high and self.word[at] == c else -1

    def _name(self, items: list[list[int]]) -> None:
        n, window = len(self.len), self.window
        # of a state's suffixes the shortest run of window words or more, which stands for the window itself
        top = array("i", bytes(4 * n))
        by_length = np.argsort(np.frombuffer(self.len, dtype=np.int32), kind="stable").tolist()
        for s in by_length[1:]:
            if self.len[s] >= window:
                up = self.link[s]
                top[s] = top[up] if self.len[up] >= window else s
        at, of, short = array("i"), array("i"), {}
        for item, ids in enumerate(items):
            state = 0
            for i, c in enumerate(ids, 1):
                state = self._step(state, c)
                if i >= window:
                    at.append(top[state])
                    of.append(item)
            if len(ids) < window:
                short.setdefault(state, []).append(item)
        pairs = np.unique(np.stack([np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, dtype=np.int32) for x in (at, of)]), axis=1)
        # rows of equal lists are one
        lists: dict[tuple[int, ...], int] = {(): 0}
        held = np.zeros(n, dtype=np.int32)
        cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1)) if pairs.shape[1] else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            held[pairs[0, low]] = lists.setdefault(tuple(pairs[1, low:high].tolist()), len(lists))
        self.held = _ints(held[np.frombuffer(top, dtype=np.int32)])
        #: Per state the row of short items that end there, of any of its suffixes.
        ends, rows = array("i", bytes(4 * n)), [()]
        for s in by_length[1:]:
            ends[s] = ends[self.link[s]]
            if s in short:
                rows.append((*rows[ends[s]], *short[s]))
                ends[s] = len(rows) - 1
        self.short = ends
        self.lists = list(lists)
        self.short_lists = [tuple((len(items[i]), self.names[i]) for i in row) for row in rows]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words of no item."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, -1)

    def scan(self, ids: list[int], start: int) -> tuple[list[list[int]], set[str]]:
        """Hit intervals [first, end) of a run of known words, and the items found."""
        state = length = 0
        spans: list[list[int]] = []
        found: set[int] = set()
        names: set[str] = set()
        step, link, size, window, held, short = self._step, self.link, self.len, self.window, self.held, self.short
        for i, c in enumerate(ids, start):
            while (to := step(state, c)) < 0 and state:
                state = link[state]
                length = size[state]
            if to < 0:
                continue
            state = to
            length += 1
            hit = 0
            if length >= window:
                hit = length
                found.add(held[state])
            if short[state]:
                for w, name in self.short_lists[short[state]]:
                    if w <= length:
                        hit = max(hit, w)
                        names.add(name)
            if hit:
                first = i - hit + 1
                while spans and first <= spans[-1][1]:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        for row in found:
            names.update(self.names[item] for item in self.lists[row])
        return spans, names


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


class _Scan:
    """Hits in a batch: row by row (first word, end) intervals and items."""

    def __init__(self, column: pa.Array, automaton: SuffixAutomaton | None):
        self.data, self.rows = tokens.utf8(column)
        hashes, self.starts, self.ends, self.first = tokens.word_hashes(self.data, self.rows, tokens.ALNUM)
        self.spans: list[list[list[int]]] = [[] for _ in range(len(column))]
        self.items: list[set[str]] = [set() for _ in range(len(column))]
        if automaton:
            self._run(automaton, automaton.ids(hashes))
            self.spans = [_merge(s) for s in self.spans]

    def add(self, row: int, spans: list[tuple[int, int]], items: list[str]) -> None:
        """Hits of a row that are known, by words of the row."""
        at = int(self.first[row])
        self.spans[row] = _merge([[a + at, b + at] for a, b in spans])
        self.items[row].update(items)

    def _run(self, automaton: SuffixAutomaton, ids: np.ndarray) -> None:
        known = ids >= 0
        before = np.concatenate([[False], known[:-1]])
        first = self.first[:-1][self.first[:-1] < len(ids)]
        before[first] = False  # a run ends where its document does
        starts = np.flatnonzero(known & ~before)
        after = np.concatenate([known[1:], [False]])
        after[self.first[self.first > 0] - 1] = False
        ends = np.flatnonzero(known & ~after) + 1
        long = ends - starts >= automaton.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            spans, items = automaton.scan(ids[a:b].tolist(), a)
            if spans:
                row = int(np.searchsorted(self.first, a, side="right")) - 1
                self.spans[row].extend(spans)
                self.items[row].update(items)

    def hit(self, row: int) -> int:
        return sum(b - a for a, b in self.spans[row])

    def clean(self, row: int, span_limit: int) -> bytes:
        """The text without hit spans of span_limit words or more."""
        at = self.rows[row]
        text = self.data[at : self.rows[row + 1]]
        keep = np.ones(len(text), dtype=bool)
        for a, b in self.spans[row]:
            if b - a >= span_limit:
                keep[self.starts[a] - at : self.ends[b - 1] - at] = False
        return text[keep].tobytes()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scans(batches, automaton, column: str = "text"):
    """Batches with their hits: of the automaton, or those that come along in columns."""
    for batch in tokens.parts(batches, column):
        scan = _Scan(batch.column(column), automaton.value if automaton else None)
        if not automaton:
            for row, (spans, items) in enumerate(zip(batch.column("known_spans"), batch.column("known_items"))):
                if spans.is_valid:
                    scan.add(row, [(x["start"], x["end"]) for x in spans.as_py()], items.as_py())
        yield batch, scan


def _span_rows(scan: _Scan) -> pa.Array:
    return pa.array([[{"start": int(a - scan.first[r]), "end": int(b - scan.first[r])} for a, b in spans] for r, spans in enumerate(scan.spans)], _SPANS)


def _found(automaton):
    """Texts with hits alone, by their key."""

    def run(batches):
        for batch, scan in _scans(batches, automaton):
            columns = [batch.column("key"), _span_rows(scan), pa.array([sorted(x) for x in scan.items], pa.list_(pa.string()))]
            rows = pa.RecordBatch.from_arrays(columns, names=["key", "spans", "items"])
            yield rows.filter(pa.array([bool(x) for x in scan.spans], pa.bool_()))

    return run


def _scanner(automaton, span_limit: int, coverage_limit: float, texts: bool):
    def run(batches):
        for batch, scan in _scans(batches, automaton):
            rows = range(batch.num_rows)
            words = np.diff(scan.first)
            hits = np.array([scan.hit(r) for r in rows], dtype=np.int64)
            out = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(words, pa.int64()),
                "n_hit": pa.array(hits),
                "items": pa.array([sorted(scan.items[r]) for r in rows], pa.list_(pa.string())),
                "dropped": pa.array(hits > coverage_limit * np.maximum(words, 1)),
            }
            if texts:
                out |= {"spans": _span_rows(scan), "clean_text": pa.array([scan.clean(r, span_limit) for r in rows], pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _clean_rows(automaton):
    def run(batches):
        for batch, scan in _scans(batches, automaton):
            yield batch.filter(pa.array([not s for s in scan.spans], pa.bool_()))

    return run


def _shards(benchmark: DataFrame, window: int):
    """An automaton for each shard, one after the other; one at least."""
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    for k in range(shards):
        part = benchmark if shards == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = part.collect()
        data, at = tokens.utf8(pa.array([r["text"] for r in rows], pa.string()))
        hashes, _, _, first = tokens.word_hashes(data, at, tokens.ALNUM)
        yield shards, SuffixAutomaton([(str(r["item_id"]), hashes[first[i] : first[i + 1]]) for i, r in enumerate(rows)], window)


def _by_shards(texts: DataFrame, benchmark: DataFrame, window: int):
    """A broadcast automaton and no hits, where one holds the benchmark; else none, and the hits (key, spans, items) of texts."""
    context = texts.sparkSession.sparkContext
    keyed, parts = texts.select(F.sha2("text", 256).alias("key"), "text").where("text is not null"), []
    for shards, automaton in _shards(benchmark, window):
        known = context.broadcast(automaton)
        if shards == 1:
            return known, None
        parts.append(materialise(keyed.mapInArrow(_found(known), "key string, spans array<struct<start: long, end: long>>, items array<string>").dropDuplicates(["key"])))
        known.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    return None, materialise(hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("known_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("known_items")))


def _with_hits(rows: DataFrame, text_column: str, hits: DataFrame) -> DataFrame:
    """Rows with the columns ``known_spans`` and ``known_items``, null where a text has no hits."""
    key = F.sha2(F.col(text_column), 256)
    if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return rows.join(hits.withColumnRenamed("key", "known_key"), key == F.col("known_key"), "left").drop("known_key")


def scan_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 10, span_limit: int = 10, coverage_limit: float = 0.5, texts: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, dropped, spans, clean_text)``, one row per row of docs.

    Words are runs of letters, digits and everything outside ASCII, A-Z
    lowered.  A window is ``window`` consecutive words of an item, or a whole
    shorter item.  ``n_hit`` counts words inside an occurrence of a window;
    ``items`` are the item ids that occur, sorted; ``spans`` are word intervals.
    ``clean_text`` is the text without hit spans of ``span_limit`` words or
    more; ``dropped`` says that over ``coverage_limit`` of the words were hit.
    Without ``texts`` the last two columns are left out.

    Null, empty and wordless texts have no words and no hits; items with no
    words have no window; a null item id is named ``None``; repeated rows and
    ids are scanned row by row; extra columns are ignored; an empty table gives
    an empty one, an empty benchmark no hits.  Documents of any length are
    scanned whole.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    automaton, hits = _by_shards(rows, benchmark, window)
    out = "doc_id long, n_words long, n_hit long, items array<string>, dropped boolean" + ", spans array<struct<start: long, end: long>>, clean_text string" * texts
    return (rows if hits is None else _with_hits(rows, "text", hits)).mapInArrow(_scanner(automaton, span_limit, coverage_limit, texts), out)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Rows of docs, with all their columns, in whose ``text`` no window occurs.

    Null, empty and wordless texts stay, and so do all rows where the benchmark
    is empty; rows that repeat stay or go alike; an empty table gives an empty one.
    """
    automaton, hits = _by_shards(docs, benchmark, window)
    if hits is None:
        return docs.mapInArrow(_clean_rows(automaton), docs.schema)
    dirty = hits.select("key")
    if dirty.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        dirty = F.broadcast(dirty)
    # docs may have a column of that name
    return docs.join(dirty, F.sha2(docs["text"], 256) == dirty["key"], "left_anti")
