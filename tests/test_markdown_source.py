from __future__ import annotations

import glob

import pytest

from vellumine.operators import pages
from vellumine.sources import markdown as M

ROWS = [(1, "a | b", "x\ny"), (2, "back\\slash \\| x", None), (3, "", "🙂")]


def test_cells_and_lines():
    for row in (["a", "b"], ["", ""], ["a|b", "\\", "c\\|"], ["one"]):
        assert M.cells(M.line(row)) == row


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(ROWS, "id int, name string, note string").repartition(2)
    pages.write(rows, path, "markdown")
    files = glob.glob(f"{path}/*.md")
    assert len(files) == 2
    for f in files:
        with open(f) as opened:
            text = opened.read()
        assert text.startswith("| id | name | note |\n| --- | --- | --- |\n| ")
    back = spark.read.format("markdown-table").load(path)
    assert back.columns == ["id", "name", "note"]
    assert sorted(map(tuple, back.collect())) == [("1", "a | b", "x y"), ("2", "back\\slash \\| x", ""), ("3", "", "🙂")]
    assert [r.note for r in spark.read.format("markdown-table").schema("note string, none string").load(path).where("note = '🙂'").collect()] == ["🙂"]


def test_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(ROWS, "id int, name string, note string")
    pages.write(rows, path, "markdown")
    pages.write(rows.where("id = 1"), path, "markdown")
    assert spark.read.format("markdown-table").load(path).count() == 1
    rows.where("id = 2").selectExpr("cast(id as string) id", "name", "note").write.format("markdown-table").mode("append").save(path)
    assert spark.read.format("markdown-table").load(path).count() == 2
    pages.write(rows.where("id = 9"), path, "markdown")
    assert len(glob.glob(f"{path}/*.md")) == 1 and spark.read.format("markdown-table").load(path).count() == 0


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    pages.write(spark.createDataFrame(ROWS, "id int, name string, note string"), path, "markdown")
    with pytest.raises(Exception, match="USER_RAISED"):
        pages.write(spark.range(4).selectExpr("if(id = 3, raise_error('no'), id) as id"), path, "markdown")
    assert spark.read.format("markdown-table").load(path).count() == 3
