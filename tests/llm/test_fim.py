from __future__ import annotations

import hashlib
import re

import pytest

from tests.conftest import DATA
from vellumine.llm import fim as M
from vellumine.llm import queries

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "a", "ab", "one two  three\n", "🙂a🙂b", "a<P>b", "x<M", "<S", "é" * 40, "line\nline\n\nlast", "a1 b22 ... c", " lead", "word " * 900, "🙂" * 5000, "x" * 4096, "x" * 4097, "long" * 3000]


def units_of(text, units):
    """Units by looking at each pair of neighbours."""
    rules = {
        M.CODE_POINTS: lambda a, b: True,
        M.WORDS: lambda a, b: a.isspace() and not b.isspace(),
        M.LINES: lambda a, b: a == "\n",
        M.RUNS: lambda a, b: kind(a) != kind(b),
    }
    out = []
    for i, c in enumerate(text):
        if i and not rules[units](text[i - 1], c):
            out[-1] += c
        else:
            out.append(c)
    return out


def kind(c):
    import unicodedata

    return {"L": 0, "M": 0, "N": 1}.get(unicodedata.category(c)[0], 2 if c in " \t\n\x0b\f\r" else 3)


def brute(doc_id, text, units, plain=90):
    text = text or ""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    pieces = units_of(text, units)
    n = len(pieces)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = ["".join(p) for p in (pieces[:low], pieces[low:high], pieces[high:])]
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= plain:
        return n, "plain", None, None, text
    p, m, s = parts
    if h4 % 100 < 20:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [M.CODE_POINTS, M.WORDS, M.LINES, M.RUNS], ids=["code points", "words", "lines", "runs"])
def test_against_brute_force(spark, units):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)]
    found = {r.doc_id: r for r in M.fill_in_middle(spark.createDataFrame(rows, SCHEMA), units).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r = found[i]
        assert (r.n, r.form, r.prefix, r.middle, r.output) == brute(i, t, units), (i, t)
    assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


def test_units_put_together_are_the_text(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    for units in (M.CODE_POINTS, M.WORDS, M.LINES, M.RUNS):
        for r in frame.select("text", M._units(frame.text, units).alias("u")).collect():
            assert "".join(r.u) == r.text
            assert r.u == units_of(r.text, units)


def test_a_chunk_that_cuts_a_unit_counts_it_once(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 5)
    rows = [(i, t) for i, t in enumerate(["aaaa bbbbbbbbbbbbbbbbbb c", "wwwww xxxxx", "🙂🙂🙂🙂🙂🙂🙂 a", "     a"] * 8)]
    for units in (M.WORDS, M.RUNS, M.CODE_POINTS):
        for r in M.fill_in_middle(spark.createDataFrame(rows, SCHEMA), units).collect():
            assert (r.n, r.form, r.prefix, r.middle, r.output) == brute(r.doc_id, r.text, units)


def test_restores_and_shares(spark):
    rows = [(i, f"text {i} with <P and M> in it") for i in range(600)]
    made = M.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    back = made.select("doc_id", "form", M.restore(made.output, made.form).alias("t")).collect()
    assert all(r.t == rows[r.doc_id][1] for r in back)
    forms = [r.form for r in back]
    assert 30 < forms.count("plain") < 100 and 60 < forms.count("spm") < 160


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "abc", 1, "x"), (5, "abc", 2, "x"), (5, "abc", 3, "x")], "doc_id long, text string, n long, output string")
    rows = M.digest(M.fill_in_middle(frame)).collect()
    assert len(rows) == 3
    assert len({r for r in rows if r.doc_id == 5}) == 1
    assert M.digest(M.fill_in_middle(frame.where("false"))).count() == 0
    assert M.fill_in_middle(frame, transformed_percent=0).where("form != 'plain'").count() == 0


def test_query(spark, duck):
    mine = sorted((tuple(r) for r in queries.op11_fim(spark, DATA).collect()), key=str)
    order = ", ".join(queries.op11_fim(spark, DATA).columns)
    assert mine == sorted(duck.execute(f"select {order} from ({queries.ORACLE_SQL['op11_fim']})").fetchall(), key=str)
    plan = queries.op11_fim(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
