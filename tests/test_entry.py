import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from crosswind.plans import board_queries, book_queries, catalog, cross_queries, ensemble_queries, factor_queries, ledger_queries, meta_queries, panel_queries, risk_queries, stateful_queries, trace_queries, universe_queries

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
SOME_FACTORS = ("inv_vol", "slope_ema", "xs", "ou_mom_blend", "exec_quality", "residual_breakout_confirmation", "leader_pullback_accumulation")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(frame):
    plain = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10]
    columns = sorted(frame.columns)
    return sorted([tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=str)


QUERIES = entry.queries()
#: Of the heavy modules some stand for all, as they share their plans.
WHOLE = [n for m in (panel_queries, risk_queries, universe_queries, ledger_queries, stateful_queries, catalog, book_queries, cross_queries, ensemble_queries, trace_queries) for n in m.oracle_sql()]
SOME = ["ic_state", "sleeve_weights", "candidate_board", "board_hash"]


@pytest.mark.parametrize("name", [*WHOLE, *SOME, *[f"f_{n}" for n in SOME_FACTORS if f"f_{n}" in QUERIES]])
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(u)), (x, y)


def test_names_are_registered_once():
    every = [n for m in entry.PLANS for n in m.queries()]
    assert len(every) == len(set(every)) and set(SOME) <= {*meta_queries.queries(), *board_queries.queries()}
    assert set(entry.oracle_sql()) <= set(QUERIES) and {f"f_{n}" for n in factor_queries.REGISTRY} <= set(QUERIES)


def test_registry_is_whole():
    assert len([n for n in entry.queries() if n.startswith("f_")]) == 105


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_all_factors_serve_all_queries(spark):
    """Strategies, sleeves and the learned score on one table of factors: shapes, bounds and that books hold what scores are there."""
    books = QUERIES["strategy_books"](spark, DATA).toPandas()
    names = set(QUERIES["strategy_scores"](spark, DATA).select("strategy_id").distinct().toPandas().strategy_id)
    assert len(names) == 23 and set(books.strategy_id) <= names and books.weight.between(0, 0.15 + 1e-9).all()
    weights = QUERIES["sleeve_weights_all"](spark, DATA).toPandas()
    assert (weights.groupby("date").weight.sum() - 1).abs().max() < 1e-3 and set(weights.sleeve) == set(ensemble_queries.SLEEVES)
    history = QUERIES["selection_history"](spark, DATA).toPandas()
    assert set(history.policy) == {"default", "patient"} and history.groupby("policy").date.nunique().nunique() == 1
    assert QUERIES["ensemble_all"](spark, DATA).count() == QUERIES["cold_start_whole"](spark, DATA).count()


def test_rest_imports_without_the_corpus_operators(tmp_path):
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('crosswind.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
