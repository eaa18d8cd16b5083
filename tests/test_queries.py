from __future__ import annotations

import importlib.util

import __spark_entry__ as contract
import pytest

from vellumine import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_against_oracle(same, name):
    same(core.QUERIES[name], core.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert 0 < contract.entry(spark).count() <= 20


def test_every_core_query_is_registered():
    assert set(core.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_missing_modules_are_skipped_and_errors_are_not(tmp_path, monkeypatch):
    assert contract._optional("vellumine.no_such_part.queries") is None
    (tmp_path / "broken_module.py").write_text("import no_such_dependency\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert importlib.util.find_spec("broken_module")
    with pytest.raises(ModuleNotFoundError, match="no_such_dependency"):
        contract._optional("broken_module")
