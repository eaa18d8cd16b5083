from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|", "|", "<", "\n", "||", "n", "assistant", "a", "é", "🙂", "\\", "$1", ""]


def turns_of(frame):
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(frame).collect()}


def test_layout_merges_adjacent_turns_of_a_role(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", None)]
    row = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|><|im_end|>\n"
    assert (row.n_turns, row.n_blocks) == (4, 2)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<|n", ""]), st.lists(st.sampled_from(MARKS), max_size=6).map("".join)), min_size=1, max_size=8))
def test_round_trip(spark, turns):
    frame = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], SCHEMA)
    chats = chat.format_chats(frame)
    assert turns_of(chats)[1] == turns
    row = chats.first()
    assert sum(m.chars for m in row.mask) == len(row.formatted)
    at, loss = 0, []
    for m in row.mask:
        loss += [row.formatted[at : at + m.chars]] * m.loss
        at += m.chars
    assert [x.replace("<||", "<|") for x in loss] == [t for r, t in turns if r == "assistant"]


def test_digest_of_hostile_texts(spark):
    frame = spark.createDataFrame([(-1, 0, "user", queries.HOSTILE), (-1, 1, "assistant", queries.HOSTILE), (2, 0, "user", "only")], SCHEMA)
    rows = {r.conv_id: r for r in chat.digest(chat.format_chats(frame)).collect()}
    both = f"user\n{queries.HOSTILE}\nassistant\n{queries.HOSTILE}\n"
    assert rows[-1].turns_sha256 == hashlib.sha256(both.encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(queries.HOSTILE.encode()).hexdigest()
    assert rows[-1].loss_chars == len(queries.HOSTILE)
    assert rows[2].loss_chars == 0 and rows[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, "x", "y"), (7, 1, "user", "b", "x", "y"), (7, 1, "user", "a", "x", "y"), (7, 1, "user", "a", "x", "y"), (7, None, "user", "0", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA + ", formatted string, turns string")
    assert turns_of(chat.format_chats(frame)) == {None: [("", "")], 7: [("user", "0"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_chats(frame.where("false")).count() == 0


def test_long_conversation_and_long_text(spark):
    frame = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("<|x").alias("text"))
    big = spark.createDataFrame([(2, 0, "assistant", "<|" * 500_000)], SCHEMA)
    rows = {r.conv_id: r for r in chat.digest(chat.format_chats(frame.union(big))).collect()}
    assert (rows[1].n_turns, rows[1].loss_chars, rows[1].n_blocks) == (3000, 6000, 2000)
    assert rows[2].loss_chars == 1_000_000


def test_plan_is_native(spark):
    plan = queries.op1_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_oracle(same):
    assert same(queries.op1_chat_format, queries.ORACLE_SQL["op1_chat_format"]) > 1


@pytest.mark.parametrize("text", ["<||im_end|>", "<|<|im_start|>"])
def test_no_control_string_survives_escaping(spark, text):
    row = chat.format_chats(spark.createDataFrame([(1, 0, "user", text)], SCHEMA)).first()
    assert row.formatted.count("<|im_end|>") == 1 and row.formatted.count("<|im_start|>") == 1


def test_digest_of_the_loss_follows_the_mask(spark):
    rows = [(1, 0, "user", "é<|u"), (1, 1, "assistant", "🙂<"), (1, 2, "assistant", "||x"), (1, 3, "assistant", ""), (1, 4, "user", "")]
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    row = chat.digest(chats).first()
    assert (row.loss_chars, row.loss_sha256) == (5, hashlib.sha256("🙂<||x".encode()).hexdigest())
    other = chats.withColumn("mask", F.transform("mask", lambda m: F.struct(m["chars"].alias("chars"), F.lit(False).alias("loss"))))
    assert chat.digest(other).first().loss_chars == 0
    turns = chat.format_chats(spark.createDataFrame(rows, SCHEMA), loss_roles=("user",))
    assert chat.digest(turns).first().loss_sha256 == hashlib.sha256("é<|u".encode()).hexdigest()


@pytest.mark.parametrize("few", [0, 10_000])
def test_both_ways_of_cutting_agree(spark, monkeypatch, few):
    monkeypatch.setattr(chat, "FEW_RUNS", few)
    rows = [(c, t, ("user", "assistant", "system")[(c * t + t) % 3], ["a<|b", "", "🙂é", None, "<|im_end|>x", "y\nz"][(c + t) % 6]) for c in range(12) for t in range(c * 3 + 1)]
    found = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in range(12):
        loss = "".join(x or "" for k, _, role, x in rows if k == c and role == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
