from __future__ import annotations

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vellumine.operators import links, lint, pages, search
from vellumine.operators.components import connected_components
from vellumine.plans import durable
from vellumine.sources import vault


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_candidates_against_brute_force(spark, distance):
    rng = random.Random(distance)
    make = [lambda: "".join(rng.choice("abé🙂") for _ in range(rng.randrange(6))) for _ in "xy"]
    names, broken = [{f() for _ in range(60)} for f in make]
    found = links.link_candidates(spark.createDataFrame([(b,) for b in broken] + [(None,), ("a",)], "target string"), spark.createDataFrame([(n + ".md",) for n in names] + [(None,)], "name string"), distance).collect()
    want = set()
    for b in broken | {"a"}:
        near = [(edits(b, n), n + ".md") for n in names if b and n]
        least = min((d for d, _ in near), default=99)
        if least <= distance:
            want |= {(b, n, d) for d, n in near if d == least}
    assert sorted(map(tuple, found)) == sorted(want)


def note(path, front, body=""):
    return (path, f"---\n{front}\n---\n{body}")


def test_aliases_resolve_after_paths(spark):
    files = spark.createDataFrame(
        [
            note("wiki/one.md", 'aliases: [First, "The 1st"]\ntitle: One'),
            note("wiki/two.md", "title: Two\naliases:\n  - Second\n  - 'two b'\nstatus: active"),
            note("x/first.md", "aliases: single"),
            note("y/none.md", "aliases:", "[[FIRST]] [[second]] [[Two B]] [[the 1st]] [[single]] [[nothing]]"),
        ],
        "path string, text string",
    )
    notes = vault.parse_notes(files)
    assert {r.path: r.aliases for r in notes.collect()} == {"wiki/one.md": ["First", "The 1st"], "wiki/two.md": ["Second", "two b"], "x/first.md": ["single"], "y/none.md": []}
    found = {r.target: r.resolved for r in links.resolve(links.note_links(notes), notes).collect()}
    assert found == {"FIRST": "x/first.md", "second": "wiki/two.md", "Two B": "wiki/two.md", "the 1st": "wiki/one.md", "single": "x/first.md", "nothing": None}


def test_metadata_of_any_field(spark):
    files = spark.createDataFrame([note("a.md", "title: One\nowner: Ann\nowner: Bob\nempty:\n- x", "text"), note("b.md", 'owner: "ANN"', "ann"), ("c.md", "no front"), ("d.md", None)], "path string, text string")
    notes = vault.parse_notes(files).withColumn("fields", vault.front_fields(F.col("front")))
    assert notes.where("path = 'a.md'").first().fields == {"title": "One", "owner": "Ann", "empty": ""}
    found = search.matches(notes, "ann", search.Fields("path", "body", (), fields="fields")).collect()
    assert sorted((r.path, r.text_hits, r.meta_hits) for r in found) == [("a.md", 0, 1), ("b.md", 1, 1)]


DOMAINS = {
    "https://a.b.example.co.uk/x": ("a.b.example.co.uk", "co.uk", "example.co.uk"), "http://co.uk": ("co.uk", "co.uk", None), "http://x.uk/": ("x.uk", "uk", "x.uk"), "https://User@WWW.Site.COM.:80/p": ("www.site.com", "com", "site.com"),
    "http://a.b.ck/": ("a.b.ck", "b.ck", "a.b.ck"), "http://b.ck/": ("b.ck", "b.ck", None), "http://www.ck": ("www.ck", "ck", "www.ck"), "http://x.www.ck": ("x.www.ck", "ck", "www.ck"),
    "http://host.unknown/": ("host.unknown", "unknown", "host.unknown"), "http://127.0.0.1/": ("127.0.0.1", None, None), "http://[::1]/": ("[::1]", None, None), "no url": ("", None, None), None: ("", None, None), "http://a..com": ("a..com", None, None),
    "http://localhost": ("localhost", "localhost", None), "https://e.example.com?q=http://x.uk": ("e.example.com", "com", "example.com"),
}


def test_registrable_domains(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("ck",), ("*.ck",), ("!www.ck",), (None,), ("*",), ("com",)], "rule string")
    urls = spark.createDataFrame([(u, "keep") for u in DOMAINS], "url string, domain string")
    found = {r.url: (r.host, r.public_suffix, r.domain) for r in pages.registrable_domains(urls, rules).collect()}
    assert found == DOMAINS
    plan = pages.registrable_domains(urls, rules)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert {r.public_suffix for r in pages.registrable_domains(urls.where("url like '%example.co.uk%'"), rules.where("false")).collect()} == {"uk"}


def test_gate_and_report_in_one_job(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("r", f"p{i}", "d", lint.BLOCK if i == 3 else lint.ADVISORY, str(i)) for i in range(7)], "rule string, path string, detail string, severity string, fingerprint string")
    found = rows.mapInArrow(seen, rows.schema)
    assert lint.gated_report(found, str(tmp_path / "r")) == lint.Gate(False, 1, 6)
    assert runs.value == 7
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/r/*.json") for x in open(f)]
    assert sorted(x["path"] for x in lines) == [f"p{i}" for i in range(7)]
    assert lint.gated_report(found.where("false"), str(tmp_path / "e")) == lint.Gate(True, 0, 0)


def test_loops_take_the_smallest_of_several_successors(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "z"), ("c", "c"), ("d", "a"), ("d", "e"), ("e", "d")], "path string, next string")
    assert sorted(r.path for r in lint.supersedes_loops(rows).collect()) == ["a", "b", "c"]


def test_the_session_names_the_root(spark, tmp_path):
    os.makedirs(tmp_path / "v")
    (tmp_path / "v" / "n.md").write_text("text")
    before = spark.conf.get(vault.ROOT_CONF, None)
    try:
        vault.use_vault(spark, str(tmp_path / "v"))
        assert [r.text for r in vault.read_markdown(spark).collect()] == ["text"]
    finally:
        spark.conf.set(vault.ROOT_CONF, before) if before else spark.conf.unset(vault.ROOT_CONF)


def test_scratch_leaves_nothing_behind(spark):
    root = durable.shared_dir(spark).rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    with durable.scratch(spark):
        with durable.scratch(spark):
            assert connected_components(edges).count() == 5
        assert set(os.listdir(root)) == before
        kept = durable.materialise(edges)
        assert kept.count() == 3
    assert set(os.listdir(root)) == before
