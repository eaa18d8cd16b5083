"""Automata over many strings, which workers build from a broadcast and keep."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Characters of strings that one automaton holds.
AUTOMATON_CHARS = 4_000_000
#: Automata that this worker has built, by their broadcasts.
_built: dict[int, object] = {}


class Strings:
    """Distinct strings, as every worker sees them; an automaton's match is a string's number."""

    def __init__(self, spark: SparkSession, strings: list[str]):
        self._shared = spark.sparkContext.broadcast(strings)
        self._id = self._shared._jbroadcast.id()

    def automaton(self):
        """The automaton; a worker keeps the last few it built."""
        import ahocorasick

        if self._id not in _built:
            while len(_built) >= 4:
                del _built[next(iter(_built))]
            made = ahocorasick.Automaton()
            for number, string in enumerate(self._shared.value):
                made.add_word(string, number)
            made.make_automaton()
            _built[self._id] = made
        return _built[self._id]
