from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vellumine.operators import search

SCHEMA = "doc_id long, text string, lang string, source string, stale boolean"


@pytest.fixture()
def docs(spark):
    rows = [(1, "alpha beta", "en", "s1", False), (2, "beta", "fr", "s2", True), (3, None, "en", None, None), (42, "nothing", "de", "s3", False), (5, "Beta beta", "en", "s1", False)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(frame):
    return [r.doc_id for r in frame.orderBy("rank").collect()]


def test_order_is_hits_then_freshness_then_id(docs):
    assert ids(search.search(docs, "beta")) == [1, 5, 2]


def test_exact_identifier_comes_first(docs):
    assert ids(search.search(docs, "beta 42"))[0] == 42


def test_metadata_match_and_nulls(docs):
    assert ids(search.search(docs, "EN")) == [1, 3, 5]


def test_limit_and_explain(docs):
    row = search.search(docs, "beta en", 1, explain=True).collect()
    assert [(r.doc_id, r.reasons) for r in row] == [(1, "text:1,metadata:1")]


def test_originals_follow_the_ranking(docs):
    found = search.search(docs, "beta", 2)
    assert [r.text for r in search.originals(found, docs).collect()] == ["alpha beta", "Beta beta"]


@pytest.mark.parametrize(
    ("query", "limit", "rows", "filters", "expected"),
    [
        ("beta", 20, True, None, ("search", None, 0)),
        ("zzz", 20, True, None, ("search", None, 0)),
        ("", 20, True, None, ("usage", "usage", 1)),
        ("beta", 0, True, None, ("usage", "usage", 1)),
        ("beta", 20, False, None, ("filtered-empty", "empty-corpus", 2)),
        ("beta", 20, True, "lang = 'xx'", ("filtered-empty", "filters-exclude-all", 2)),
    ],
)
def test_envelope(docs, query, limit, rows, filters, expected):
    out = search.run_search(lambda: docs if rows else docs.where("false"), query, limit, filters=F.expr(filters) if filters else None)
    assert (out.mode, out.reason, out.exit_code) == expected
    assert json.loads(out.to_json())["exit_code"] == expected[2]


def test_envelope_of_unreadable_and_broken_corpora(spark):
    assert search.run_search(lambda: spark.read.parquet("/no/such/path"), "x").exit_code == 3

    def broken():
        raise RuntimeError("boom")

    out = search.run_search(broken, "x")
    assert (out.exit_code, out.reason) == (5, "boom")


def test_plan_prunes_and_does_not_shuffle(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = search.matches(docs, "beta")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "n_chars" not in plan
