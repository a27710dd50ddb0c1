"""The entry points with and without the corpus operators."""

from __future__ import annotations

import importlib.util

import __spark_entry__ as entry_points

from flightops.plans.queries import QUERIES


def test_queries_without_the_corpus_operators(monkeypatch):
    found = importlib.util.find_spec

    def missing(name, *args):
        return None if name in ("flightops.llm", "corpus_pipeline") else found(name, *args)

    monkeypatch.setattr(importlib.util, "find_spec", missing)
    assert set(entry_points.queries()) == set(QUERIES)
    assert set(entry_points.oracle_sql()) == set(QUERIES)


def test_every_sql_text_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
