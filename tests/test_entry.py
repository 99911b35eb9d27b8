"""The driver's entry points."""

import __spark_entry__


def test_queries_and_sql_agree():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "fvs_final" in names


def test_training_queries_are_left_out_where_they_are_not_installed(monkeypatch):
    find = __spark_entry__.importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda name: None if name.startswith("acyclica.llm") else find(name))
    assert __spark_entry__._llm() == ({}, {})
    assert "fvs_final" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
