from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vellumine.operators import lint, links
from vellumine.operators.components import connected_components
from vellumine.plans import automata, phrases
from vellumine.sources import vault


@pytest.fixture(scope="module")
def notes(spark):
    texts = {
        "projects/a": "---\ntype: project\nstatus: active\nsource: [[raw/one]]\n---\nSee [[decisions/b]], [[B]], [[missing]] and [[a]].",
        "decisions/b": "---\ntype: decision\nstatus: archived\nrevisit: 2020-01-01\n---\ntext",
        "insights/c": "---\ntype: insight\nstatus: odd\n---\nalone",
    }
    return vault.parse_notes(spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()], "path string, text string")).cache()


@pytest.fixture(scope="module")
def resolved(notes):
    return links.resolve(links.note_links(notes), notes).cache()


def test_links_resolve_by_path_and_by_name(resolved):
    found = {(r.target, r.origin): r.resolved for r in resolved.collect()}
    assert found == {("decisions/b", "body"): "decisions/b.md", ("B", "body"): "decisions/b.md", ("missing", "body"): None, ("a", "body"): "projects/a.md", ("raw/one", "frontmatter"): None}


def test_audit(resolved):
    assert {(r.origin, r.status): (r.n_links, r.n_targets) for r in links.audit(resolved).collect()} == {("body", "resolved"): (3, 3), ("body", "unresolved"): (1, 1), ("frontmatter", "unresolved"): (1, 1)}


def test_graph_and_connectivity(notes, resolved, tmp_path, spark):
    vertices, edges = links.build_graph(resolved, notes)
    assert [tuple(r) for r in edges.collect()] == [("projects/a.md", "decisions/b.md", 2)]
    found = links.connectivity(vertices, edges)
    assert {r.path: (r.component, r.n_members, r.isolated) for r in found.collect()} == {"projects/a.md": ("decisions/b.md", 2, False), "decisions/b.md": ("decisions/b.md", 2, False), "insights/c.md": ("insights/c.md", 1, True)}
    assert links.connectivity_exit_code(found) == 2
    links.build_graph(resolved, notes, cache=str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 1
    near = links.neighbourhood(vertices, edges, "projects", hops=1)
    assert {r.path: r.distance for r in near.collect()} == {"projects/a.md": 0, "decisions/b.md": 1}


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_unlinked_mentions_are_whole_words_and_not_linked(spark, monkeypatch, limit):
    monkeypatch.setattr(automata, "AUTOMATON_CHARS", limit)
    texts = spark.createDataFrame([(1, "The Great Plan, of old"), (2, "the great plan"), (3, "A Great Planet"), (4, "Great-Plan!"), (5, None)], "id long, text string")
    titles = spark.createDataFrame([("t", "Great Plan"), ("u", "The"), ("v", None)], "name string, title string")
    assert {(r.id, r.name) for r in links.unlinked_mentions(texts, titles).collect()} == {(1, "t"), (4, "t")}
    linked = spark.createDataFrame([(1, "t")], "id long, name string")
    assert {r.id for r in links.unlinked_mentions(texts, titles, linked).collect()} == {4}
    # names of one title are all there, a text that has a title twice once
    more = spark.createDataFrame([("t", "Great Plan"), ("t2", "great... PLAN"), ("t3", "Great plan"), ("t4", "Great-Plan")], "name string, title string")
    twice = spark.createDataFrame([(7, "Great Plan Great Plan, great PLAN")], "id long, text string")
    assert sorted((r.id, r.name) for r in links.unlinked_mentions(twice, more).collect()) == [(7, "t"), (7, "t2"), (7, "t4")]
    assert links.unlinked_mentions(twice, more.where("false")).count() == 0


def test_many_titles_shuffle_no_text(spark, monkeypatch):
    """Titles of a common word, which each text holds, in parts of long texts that overlap."""
    rng = random.Random(3)
    words = ["é", "Plan", "plan", "commonest", "of", "x" * 40]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", ".\n"]) for _ in range(rng.choice([0, 1, 3, 300])))) for i in range(60)]
    titles = sorted({"-".join([*(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9]))), "commonest"]) for _ in range(400)} | {"Plan of", "...", "", "x" * 40 + " plan"})
    squeezed = {i: " " + " ".join(re.findall(r"\w+", text)) + " " for i, text in texts}
    frames = spark.createDataFrame([*texts, (99, None)], "id long, text string"), spark.createDataFrame([(t, t) for t in titles], "name string, title string")
    for segment, at_once in ((1 << 20, 4_000_000), (50, 100)):
        monkeypatch.setattr(phrases, "SEGMENT", segment)
        monkeypatch.setattr(phrases, "AT_ONCE", at_once)
        for least in (1, 2):
            needles = {t: " " + " ".join(w) + " " for t in titles if len(w := re.findall(r"\w+", t)) >= least}
            found = links.unlinked_mentions(*frames, min_words=least).collect()
            assert len(found) == len(set(found))
            assert {(r.id, r.name) for r in found} == {(i, t) for i, text in squeezed.items() for t, n in needles.items() if n in text}
    hay = frames[0].select("id", F.col("text").alias("hay"))
    plan = phrases.find_phrases(hay, frames[1].select(F.lit(" Plan of ").alias("needle")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (100, 101), (100, 101)]
    edges += [(200 + i, 201 + i) for i in range(20)] + [(300, 301 + i) for i in range(20)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(frame).collect()} == brute_components(edges)


def test_components_of_nothing_and_of_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (None, 2)], "a long, b long")).count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([("x", "x")], "a string, b string")).collect()] == [("x", "x")]


def found(frame):
    return sorted((r.path, r.detail) for r in frame.collect())


def test_status_rule(spark, notes):
    allowed = spark.createDataFrame([("project", "active"), ("decision", "archived")], "type string, status string")
    assert found(lint.status_enum(notes, allowed)) == [("insights/c.md", "insight/odd")]
    assert found(lint.status_enum(spark.createDataFrame([("x", None, None)], "path string, type string, status string"), allowed)) == [("x", "?/?")]


def test_catalog_rules(spark, notes):
    catalog = spark.createDataFrame([("cat", "decisions/b"), ("cat", "gone/x"), ("cat", "projects/a")], "catalog string, link string")
    assert found(lint.catalog_check(notes, catalog)) == [("decisions/b", "no such page"), ("gone/x", "no such page"), ("insights/c", "not in a catalog")]
    assert found(lint.archived_in_catalog(catalog, notes)) == [("decisions/b", "cat")]
    router = spark.createDataFrame([("C", 3, "cat"), ("D", 1, "none")], "category string, declared_rows long, catalog string")
    assert found(lint.row_count_sync(router, catalog)) == [("none", "1 of 0")]


def test_link_and_date_rules(spark, notes, resolved):
    assert ("projects/a.md", "missing") in found(lint.broken_links(resolved))
    assert found(lint.revisit_due(notes, F.lit("2021-01-01").cast("date"))) == [("decisions/b.md", "2020-01-01")]
    assert found(lint.unsourced(notes, spark.createDataFrame([("raw/two",)], "path string"))) == [("projects/a.md", "raw/one")]
    assert found(lint.superseded_active(notes, spark.createDataFrame([("x", "projects/a.md")], "source string, target string"))) == [("projects/a.md", "active")]
    day = F.lit("2026-10-03").cast("date")
    assert found(lint.changelog_sync(F.lit(None).cast("date"), day, spark)) == [("CHANGELOG", "none / 2026-10-03")]
    assert found(lint.changelog_sync(day, day, spark)) == []


def test_fixtures_facts_baseline_and_gate(spark, resolved):
    fixtures = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    expected = fixtures.select("path", F.sha2("text", 256).alias("sha256")).where("path = 'a'").union(spark.createDataFrame([("b", "0"), ("c", "0")], "path string, sha256 string"))
    assert [r.path for r in lint.fixture_integrity(fixtures, expected).orderBy("path").collect()] == ["b", "c"]
    facts = spark.createDataFrame([("k", "p"), ("k", "q"), ("k", "q"), ("l", "p")], "fact_key string, path string")
    assert found(lint.duplicate_facts(facts)) == [("k", "2")]
    broken = lint.broken_links(resolved)
    assert lint.gate(broken) == lint.Gate(False, 2, 0)
    assert lint.gate(lint.beyond_baseline(broken, broken)) == lint.Gate(True, 0, 0)
    assert lint.changed_only(broken, spark.createDataFrame([("other",)], "path string")).count() == 0


def test_loops_of_superseding_notes(spark):
    steps = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "f"), ("g", "gone"), ("h", None), (None, "a"), *((f"n{i}", f"n{i + 1}") for i in range(50))]
    frame = spark.createDataFrame(steps, "path string, next string")
    assert found(lint.supersedes_loops(frame)) == [("a", "b"), ("b", "c"), ("c", "a"), ("f", "f")]
    assert found(lint.supersedes_loops(frame.where("false"))) == []


def test_drift_as_a_report(spark, notes):
    catalog = spark.createDataFrame([("cat", "projects/a")], "catalog string, link string")
    none = spark.createDataFrame([], "source string, target string")
    steps = spark.createDataFrame([("x", "x")], "path string, next string")
    lines = [json.loads(r.value) for r in lint.as_report(lint.drift(notes, catalog, none, steps)).collect()]
    assert {(r["rule"], r["path"]) for r in lines} == {("catalog", "insights/c"), ("supersedes-loop", "x")}
