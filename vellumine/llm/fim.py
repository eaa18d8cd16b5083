"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says what a text is made of: code points, words, lines, runs of
classes.  It is translated to a regular expression of zero width that looks at
the code point on either side of a place and matches where one unit ends and the
next starts.  Spark's ``split`` at that expression keeps every character, so the
units put together are the text again.

A text is read in chunks of ``CHUNK`` code points, for the units of a chunk are
objects of their own and those of a whole long text would fill a task.  As a
boundary depends on its two neighbours only, a chunk's edge is looked at apart:
where it is no boundary, the unit that it cuts is counted once.

All of it is built from Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096

# The control strings of the output, and the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARK = "<[PSM]>"


@dataclass(frozen=True)
class Units:
    """A unit grammar over classes, each the inside of a character class.

    A unit ends where a code point of a ``before`` class is followed by one of the
    paired ``after`` class (empty: any code point).  Code points of one of the
    ``runs`` classes stand together with their like, and part from all others.
    """

    pairs: tuple[tuple[str, str], ...] = ()
    runs: tuple[str, ...] = ()

    def boundary(self) -> str:
        """The zero-width expression between two neighbours."""

        def one(inside: str, negated: bool = False) -> str:
            return f"[{'^' * negated}{inside}]" if inside else "."

        sides = [(one(a), one(b)) for a, b in self.pairs]
        for run in self.runs:
            sides += [(one(run), one(run, True)), (one(run, True), one(run))]
        return "(?s)" + "|".join(f"(?<={a})(?={b})" for a, b in sides)


CODE_POINTS = Units(pairs=(("", ""),))
#: A word with the white space behind it.
WORDS = Units(pairs=((r"\s", r"\S"),))
#: A line with its line feed.
LINES = Units(pairs=((r"\n", ""),))
#: Runs of letters, of digits, of white space and of anything else.
RUNS = Units(runs=(r"\p{L}\p{M}", r"\p{N}", r"\s"))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _units(text: Column, units: Units) -> Column:
    """The units of a text that is not empty, in order."""
    return F.split(text, units.boundary())


def _glued(chunks: Column, i: Column, units: Units) -> Column:
    """1 if the i-th chunk (from 0) starts inside a unit, else 0."""
    seam = F.concat(F.right(F.get(chunks, i - 1), F.lit(1)), F.left(F.get(chunks, i), F.lit(1)))
    return F.when((i > 0) & ~F.regexp_like(seam, F.lit(units.boundary())), 1).otherwise(0)


def _with_units(rows: DataFrame, units: Units) -> DataFrame:
    """Adds ``_chunks``, ``_starts`` (units that start in each chunk) and ``n``; the empty text has none."""
    rows = rows.withColumn("_chunks", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(_chunks(F.col("text"))))
    starts = F.transform("_chunks", lambda c, i: F.size(_units(c, units)) - _glued(F.col("_chunks"), i, units))
    rows = rows.withColumn("_starts", starts)
    return rows.withColumn("n", F.aggregate("_starts", F.lit(0).cast("long"), lambda n, x: n + x))


def _offset(cut: Column, units: Units) -> Column:
    """Code points before the unit of this number (from 0); all of them, if there is none."""
    place = F.struct(F.lit(0).alias("chunk"), cut.cast("long").alias("left"), F.lit(False).alias("here"))

    def step(at: Column, starts: Column) -> Column:
        here = at["here"] | (at["left"] < starts)
        return F.struct(F.when(here, at["chunk"]).otherwise(at["chunk"] + 1).alias("chunk"), F.when(here, at["left"]).otherwise(at["left"] - starts).alias("left"), here.alias("here"))

    def inside(at: Column) -> Column:
        ahead = (at["left"] + _glued(F.col("_chunks"), at["chunk"], units)).cast("int")
        before = F.slice(_units(F.get("_chunks", at["chunk"]), units), F.lit(1), ahead)
        return F.when(at["here"], at["chunk"] * CHUNK + F.length(F.array_join(before, ""))).otherwise(F.length("text"))

    # the chunk in which the unit starts, and how many start there before it
    found = F.aggregate("_starts", place, step)

    return F.element_at(F.transform(F.array(found), inside), 1)


def _draws(doc_id: Column, seed: int, n: int) -> list[Column]:
    """Numbers of 32 bits from the hash of a seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, units: Units = CODE_POINTS, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, transformed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``(doc_id, text, n, form, prefix, middle, suffix, output)``, one row per row of docs.

    ``n`` counts the text's units.  Two cuts among them, drawn from a hash of the
    id, part it in three; ``output`` says them in the order of the form, each
    behind its control string.  Form is plain, and the output the text, where the
    text is empty, holds a control string, or by the draw.

    Null texts are empty; a null id draws as the empty string; repeated rows are
    cut alike; other columns are ignored; an empty table gives an empty one.  A
    long text is read in chunks, and its units are never held together.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed, 4)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = _with_units(rows, units)
    free = (F.col("text") == "") | F.regexp_like("text", F.lit(_MARK)) | (h3 % 100 >= transformed_percent)
    rows = rows.withColumn("form", F.when(free, PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = F.col("form") != PLAIN
    rows = rows.withColumn("_low", F.when(cut, _offset(F.least(a, b), units))).withColumn("_high", F.when(cut, _offset(F.greatest(a, b), units)))
    low, high = F.col("_low"), F.col("_high")
    rows = rows.select(
        "doc_id", "text", "n", "form",
        F.when(cut, F.left("text", low)).alias("prefix"),
        F.when(cut, F.substr("text", low + 1, high - low)).alias("middle"),
        F.when(cut, F.substr("text", high + 1, F.length("text") - high)).alias("suffix"),
    )
    parts = {PREFIX: "prefix", SUFFIX: "suffix", MIDDLE: "middle"}
    said = {form: F.concat(*[x for mark in order for x in (F.lit(mark), F.col(parts[mark]))]) for form, order in ((PSM, (PREFIX, SUFFIX, MIDDLE)), (SPM, (SUFFIX, PREFIX, MIDDLE)))}
    return rows.withColumn("output", F.when(F.col("form") == PSM, said[PSM]).when(F.col("form") == SPM, said[SPM]).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.transform(F.array(F.split(output, _MARK, -1)), lambda p: F.when(form == PSM, F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))))
    return F.when(form == PLAIN, output).otherwise(F.element_at(parts, 1))


def digest(made: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of what ``fill_in_middle`` made."""
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
