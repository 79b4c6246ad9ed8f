"""Derived bars, factor scores, books and sleeves are made once and read where they are kept."""

import pytest

import __spark_entry__ as entry
from crosswind.operators.factors import REGISTRY
from crosswind.plans import ensemble_queries, factor_queries, strategy_queries
from crosswind.sources.panels import run_sql

DATA = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.mark.parametrize("name", ["board_hash", "unit_book", "sleeve_weights", "ensemble_score", "ic_state", "bars_densify"])
def test_line_items_are_read_for_the_bars_alone(spark, name):
    files = QUERIES[name](spark, DATA).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


@pytest.mark.parametrize("part", [strategy_queries.panel_rows, ensemble_queries._targets])
def test_rows_of_strategies_and_sleeves_are_made_of_kept_bars(spark, part):
    files = part(spark, DATA).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_factors_of_strategies_are_made_of_kept_bars(spark, monkeypatch):
    read = []
    monkeypatch.setattr(factor_queries, "run_sql", lambda spark, sf_dir, sql: read.append(run_sql(spark, sf_dir, sql).inputFiles()) or run_sql(spark, sf_dir, sql))
    factor_queries.scores(spark, DATA, tuple(list(REGISTRY)[5:8]))
    assert read and not [f for files in read for f in files if "lineitem" in f]


def test_sleeves_are_not_part_of_the_statement_above_them(spark):
    files = QUERIES["sleeve_weights"](spark, DATA).inputFiles()
    assert any("/sleeves-" in f for f in files) and not any("/scores-" in f for f in files)


def test_factors_of_several_statements_are_those_of_one(spark, monkeypatch):
    names = tuple(list(REGISTRY)[:5])
    got = factor_queries.scores(spark, DATA, names).toPandas()
    monkeypatch.setattr(factor_queries, "BATCH", 2)
    split = factor_queries.scores(spark, DATA, names).toPandas()
    keys = ["date", "asset"]
    assert list(got.columns) == list(split.columns) == [*keys, *names]
    assert split.sort_values(keys, ignore_index=True).equals(got.sort_values(keys, ignore_index=True))
