from __future__ import annotations

import datetime

from vellumine.sources import vault


def files(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()], "path string, text string")


def test_note_with_frontmatter(spark):
    text = '---\ntitle: "A plan"\ntype: project\nstatus: active\nsummary: short\nrevisit: 2025-02-03\nrelated: [[people/ann]]\n---\n# Heading\nSee [[decisions/b|B]] and [[c#part]].\n'
    row = vault.parse_notes(files(spark, a=text)).first()
    assert (row.title, row.type, row.status, row.summary, row.revisit) == ("A plan", "project", "active", "short", datetime.date(2025, 2, 3))
    assert row.front_links == ["people/ann"]
    assert row.body_links == ["decisions/b", "c"]


def test_note_without_frontmatter(spark):
    rows = {r.path: r for r in vault.parse_notes(files(spark, a="# Only a heading\n", b="", c=None)).collect()}
    assert rows["a.md"].title == "Only a heading"
    assert rows["a.md"].type is None
    assert rows["b.md"].title is None and rows["b.md"].body_links == []
    assert rows["c.md"].body == ""


def test_bad_revisit_date_is_null(spark):
    assert vault.parse_notes(files(spark, a="---\nrevisit: soon\n---\n")).first().revisit is None


CATALOG = """# Catalog

> a hint with [[index]]

## Live

| page | summary |
|---|---|
| [[projects/a]] | first one |
| [[projects/b\\|B]] | second — one |
| _none yet_ | |

## Old

| [[projects/c]] | third |
"""


def test_catalog_rows(spark):
    rows = {r.link: r for r in vault.parse_catalog(files(spark, **{"index-projects": CATALOG})).collect()}
    assert set(rows) == {"projects/a", "projects/b", "projects/c"}
    assert (rows["projects/a"].catalog, rows["projects/a"].section, rows["projects/a"].summary) == ("index-projects", "Live", "first one")
    assert rows["projects/c"].section == "Old"


def test_placeholder_rows_count_as_none(spark):
    assert vault.parse_catalog(files(spark, a="## S\n\n| _none yet_ | |\n")).count() == 0


def test_research_rows(spark):
    rows = {r.link: r for r in vault.parse_research(files(spark, r="## G\n| [[x]] | survey — of things — many |\n| [[y]] | plain |\n")).collect()}
    assert (rows["x"].kind, rows["x"].summary) == ("survey", "of things — many")
    assert rows["y"].kind is None


def test_router_rows(spark):
    row = vault.parse_router(files(spark, index="| c | n | k | d |\n|---|---|---|---|\n| Projects | 12 | [[index-projects]] | all of them |\n")).first()
    assert tuple(row) == ("Projects", 12, "index-projects", "all of them")


def test_log_lines(spark):
    rows = vault.parse_log(files(spark, log="# Log\n## [2025-01-02] ingest | three files\n## [2025-99-02] lint | bad day\n## nothing\n")).collect()
    assert [tuple(r) for r in rows] == [(datetime.date(2025, 1, 2), "ingest", "three files"), (None, "lint", "bad day")]


def test_reading_files_and_terms(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("# N\nline\n")
    (tmp_path / "terms").write_text("one\n\n one \ntwo\n")
    assert [r.text for r in vault.read_markdown(spark, str(tmp_path)).collect()] == ["# N\nline\n"]
    assert sorted(r.term for r in vault.read_terms(spark, str(tmp_path / "terms")).collect()) == ["one", "two"]


def test_root_falls_through_empty_names():
    assert vault.vault_root("", None, "b", default="d") == "b"
    assert vault.vault_root(None, "", default="d") == "d"


def test_the_root_is_kept_in_the_session(spark):
    spark.conf.unset(vault.ROOT_CONF)
    assert vault.use_vault(spark, "", default="d") == "d"
    assert vault.use_vault(spark, "e") == "e" and vault.use_vault(spark) == "e"
    spark.conf.unset(vault.ROOT_CONF)


def test_dates_of_index_and_changelog(spark):
    texts = {"index": "# I\n\nLast updated: 2026-10-03 - refresh. See [[CHANGELOG]].\n", "CHANGELOG": "# C\n\n## 2026-01-02\n- a\n\n## [2026-03-04] b\n", "empty": "# C\n\n## (none)\n", "odd": "Last updated: 2026-99-99"}
    rows = {r.path: r.updated for r in vault.parse_updated(files(spark, **texts)).collect()}
    assert rows == {"index.md": datetime.date(2026, 10, 3), "CHANGELOG.md": datetime.date(2026, 3, 4), "empty.md": None, "odd.md": None}


def test_links_keep_digits_at_their_ends(spark):
    row = vault.parse_notes(files(spark, a="---\nx: [[150]] [[ 11 ]]\n---\n[[0a0]] [[1b1]] [[222]]")).first()
    assert row.front_links == ["150", "11"] and row.body_links == ["0a0", "1b1", "222"]
