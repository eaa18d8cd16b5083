"""Chat formatting with Spark expressions only.

A conversation becomes one string.  Adjacent turns of one role share a block:

    <|im_start|>role\\n text <|im_sep|> text ... <|im_end|>\\n

``<|`` inside a text or role is written ``<||``, so no control string can occur
there; a line feed inside a role is written ``<|n``.  Both steps are undone by
``read_chats``, which gives back every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def _quoted(mark: str) -> str:
    return f"\\Q{mark}\\E"


def _escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("<|n"))


def _unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Runs of one role: an array of (role, texts)."""
    n = F.size(turns)
    opens = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    bounds = F.concat(opens, F.array(n + 1))
    return F.transform(opens, lambda i, k: F.struct(F.element_at(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i, F.element_at(bounds, k + 2) - i), lambda x: x["text"]).alias("texts")))


def _block(block: Column) -> Column:
    body = F.array_join(F.transform(block["texts"], _escape), SEP)
    return F.concat(F.lit(START), _escape_role(block["role"]), F.lit("\n"), body, F.lit(END + "\n"))


def _mask(block: Column, loss_roles: list[str]) -> Column:
    """Runs of characters of one block: (chars, whether they count for the loss)."""
    learnt = block["role"].isin(loss_roles)

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    head = run(F.length(_escape_role(block["role"])) + len(START) + 1, F.lit(False))
    texts = F.flatten(F.transform(block["texts"], lambda x, k: F.array(run(F.when(k == 0, 0).otherwise(len(SEP)), F.lit(False)), run(F.length(_escape(x)), learnt))))
    return F.concat(F.array(head), texts, F.array(run(F.lit(len(END) + 1), F.lit(False))))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, n_turns, n_blocks, formatted, mask)``, one row per conversation.

    Turns are ordered by turn, then role and text, nulls first, so ties have one
    result; repeated rows all stay.  A null text or role is empty; rows with a
    null conversation form one conversation of their own; extra columns are
    ignored; an empty table gives an empty one.  A conversation is one row of
    the result and so must fit a task, whatever its share of the table.

    ``mask`` holds runs (chars, loss) over ``formatted``, in code points; the
    loss is on the texts of ``loss_roles``, never on marks.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.select(F.col(conv).alias("conv_id"), row.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    blocks = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _merged(F.col("turns")).alias("blocks"))
    return blocks.select(
        "conv_id",
        "n_turns",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", _block), "").alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: _mask(b, list(loss_roles)))).alias("mask"),
    )


def read_chats(chats: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds ``turns``, an array of (role, text), read back from the formatted string."""

    def block(raw: Column) -> Column:
        role = F.substring_index(raw, "\n", 1)
        body = F.substring_index(F.substr(raw, F.length(role) + 2), END, 1)
        return F.transform(F.split(body, _quoted(SEP)), lambda part: F.struct(_unescape_role(role).alias("role"), _unescape(part).alias("text")))

    raw = F.split(F.col(formatted), _quoted(START))
    return chats.withColumn("turns", F.flatten(F.transform(F.slice(raw, F.lit(2), F.size(raw) - 1), block)))


#: Runs of a mask up to which they are cut out one by one; a longer mask is laid over the characters.
FEW_RUNS = 100


def _loss_text(formatted: Column, mask: Column) -> Column:
    """The texts that the loss is on: the string cut by the mask's runs, each unescaped and then joined.

    A cut counts characters from the start of the string, so many cuts would
    take the square of its length; those are made in one pass over all characters.
    """
    return F.when(F.size(mask) <= FEW_RUNS, _cut(formatted, mask)).otherwise(_overlaid(formatted, mask))


def _cut(formatted: Column, mask: Column) -> Column:
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at: int, chars: int>>").alias("runs"))

    def add(done: Column, m: Column) -> Column:
        chars = m["chars"].cast("int")
        run = F.struct(done["at"].alias("at"), chars.alias("chars"))
        return F.struct((done["at"] + chars).alias("at"), F.when(m["loss"], F.concat(done["runs"], F.array(run))).otherwise(done["runs"]).alias("runs"))

    runs = F.aggregate(mask, empty, add, lambda done: done["runs"])
    return F.array_join(F.transform(runs, lambda r: _unescape(F.substr(formatted, r["at"], r["chars"]))), "")


def _overlaid(formatted: Column, mask: Column) -> Column:
    # for each character whether it counts, and two more where a run starts
    flags = F.flatten(F.transform(mask, lambda m: F.when(m["chars"] > 0, F.concat(F.array(m["loss"].cast("int") + 2), F.array_repeat(m["loss"].cast("int"), (m["chars"] - 1).cast("int")))).otherwise(F.array().cast("array<int>"))))
    marked = F.transform(F.arrays_zip(F.split(formatted, "").alias("char"), flags.alias("flag")), lambda x: F.concat(F.when(x["flag"] >= 2, END).otherwise(""), F.when(x["flag"] % 2 == 1, x["char"]).otherwise("")))
    # no run of loss holds an end mark, which parts the runs here
    return F.array_join(F.transform(F.split(F.array_join(marked, ""), _quoted(END)), _unescape), "")


def digest(chats: DataFrame) -> DataFrame:
    """Digests of what ``read_chats`` gives back, and of the texts that the mask marks."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = _loss_text(F.col("formatted"), F.col("mask"))
    wide = read_chats(chats).select("conv_id", "formatted", "n_blocks", F.size("turns").cast("long").alias("n_turns"), lines.alias("lines"), loss.alias("loss"))
    return wide.select(
        "conv_id",
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
