from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from vellumine.operators import search
from vellumine.operators.gram_index import GramIndex

SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = [
    (1, "A needle in here", "en", "web"), (2, "nothing of note", "de", "web"), (3, None, "fr", "needle"), (4, "", None, None), (5, "nee dle", "en", "book"),
    (6, "🙂nad🙂", "en", "web"), (7, "NEEDLES and needles", "de", "book"), (42, "ab", "en", "web"),
]
QUERIES = ["needle", "NEEDLE web", "42", "fr", "zzz", "a", "🙂na", "nad🙂", "of note", "ab", "qqqq 7", "edl"]


def build(spark, path):
    index = GramIndex(spark, str(path))
    rows = spark.createDataFrame(ROWS, SCHEMA)
    index.add(rows.where("doc_id < 5"), 1, F.col("doc_id"))
    index.add(rows.where("doc_id >= 5"), 2, blocks=3)
    return index, rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("index"))


@pytest.mark.parametrize("query", QUERIES)
def test_finds_what_the_grep_finds(built, query):
    index, rows = built
    assert sorted(map(tuple, index.matches(query).collect())) == sorted(map(tuple, search.matches(rows, query).collect()))


def test_reads_few_blocks(built):
    index, _ = built
    report = index.report("note").first()
    assert (report.read_blocks, report.read_bytes) == (1, len("nothing of note"))
    assert index.report("qqq").first().read_blocks == 0
    every = index.report("a").first()
    assert every.n_blocks == every.read_blocks and every.n_bytes == every.read_bytes
    plan = index.matches("note")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_an_addition_leaves_the_others_alone_and_can_be_repeated(spark, tmp_path):
    index, rows = build(spark, tmp_path / "x")
    before = {p for p in glob.glob(f"{tmp_path}/x/*/addition=1/**/*.parquet", recursive=True)}
    new = spark.createDataFrame([(100, "another needle", "en", "web")], SCHEMA)
    for _ in range(2):
        index.add(new, 3)
    assert before == {p for p in glob.glob(f"{tmp_path}/x/*/addition=1/**/*.parquet", recursive=True)}
    assert sorted(r.doc_id for r in index.matches("needle").collect()) == [1, 3, 7, 100]
    index.add(new.where("false"), 4)
    assert index.matches("needle").count() == 4


@pytest.mark.parametrize("query", ["needle web", "zzz"])
def test_originals_from_their_blocks(built, query):
    index, rows = built
    found = search.search(rows, query, 3)
    mine, theirs = index.originals(found), search.originals(found, rows)
    assert [tuple(r) for r in mine.select(theirs.columns).collect()] == [tuple(r) for r in theirs.collect()]
    if query != "zzz":
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan and "PushedFilters: [In(doc_id" in plan


def test_other_fields(spark, tmp_path):
    fields = search.Fields("path", "body", ("kind",))
    index = GramIndex(spark, str(tmp_path / "y"), fields)
    index.add(spark.createDataFrame([("a/b", "Some text", "note", 1), ("c", "other", None, 2)], "path string, body string, kind string, n int"), 0)
    assert [r.path for r in index.matches("note").collect()] == ["a/b"]
    assert [(r.path, r.exact) for r in index.matches("C").collect()] == [("c", True)]


def test_freshness_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "t", "old"), (2, "u", "old")], "doc_id long, text string, stale string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    found = search.with_freshness(docs, labels, "doc_id", F.col("toxic") == 1)
    assert sorted((r.doc_id, r.text, r.stale) for r in found.collect()) == [(1, "t", True), (2, "u", False)]


def test_the_text_is_lowered_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = search.matches(docs, "one two three four")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1
