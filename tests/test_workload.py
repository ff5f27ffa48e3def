"""The driver contract: names, checks and a sample of queries against their SQL."""

import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, canon  # noqa: E402
from tickloom.workload import load  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "S1_W1_W2_W3_tick_extract", "D1_dc_events", "D6_dc_tick_features_v2", "J1_asof_backward",
    "J8_reconcile_orders", "W6_rolling_regime", "T1_pair_fills", "T4_dc_trades",
    "A3_paired_statistics", "A12_percentiles", "T12_tune_anchors", "P13_orders_to_actions",
]

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


def test_every_check_belongs_to_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries)
    own = set(load().QUERIES)  # the optional subpackage tests its own queries
    assert own <= set(queries)
    assert {q for q in own if q not in checks} == {
        "A3_paired_tests", "A4_comparison_report", "M2_M3_tabular_regression",
    }


@pytest.mark.parametrize("absent", ["tickloom.llm", "tickloom.llm.queries", "xxhash"])
def test_without_the_optional_subpackage(monkeypatch, absent):
    for name in [m for m in sys.modules if m.startswith("tickloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)  # importing it fails
    assert set(entry.queries()) == set(load().QUERIES) and set(entry.oracle_sql()) == set(load().CHECKS)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r.num_up_regimes > 0 for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    mine = canon(entry.queries()[name](spark, FOLDER).toPandas())
    theirs = canon(con.execute(entry.oracle_sql()[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


def test_filters_and_columns_reach_the_scan(spark):
    out = entry.queries()["S13_read_fills"](spark, FOLDER)
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "EqualTo(event_type,click)" in pushed
    assert "props" not in plan.split("ReadSchema")[1]


def test_supervised_windows_end_to_end(spark):
    from tickloom.plans.features import WindowPlan, supervised_windows
    from tickloom.workload.registry import Tables

    plan = WindowPlan(
        thresholds=(0.1, 0.3), length=10, gap=5, horizon=2, span="7 days", order=("event_id",)
    )
    ticks = Tables(spark, FOLDER).ticks
    out = supervised_windows(ticks, plan).cache()
    first = out.first()
    assert len(first.x) == 10 and len(first.x[0]) == 13 and len(first.y) == 2
    per_symbol = {r.symbol: r["count"] for r in ticks.groupBy("symbol").count().collect()}
    for r in out.groupBy("symbol", "split").count().collect():
        n = per_symbol[r.symbol]
        rows = {"train": int(n * 0.7), "val": int(n * 0.9) - int(n * 0.7), "test": n - int(n * 0.9)}
        assert r["count"] == rows[r.split] - 16


def test_fills_that_are_opened_and_partly_closed_many_times(spark, tmp_path):
    """Sixteen copies of one wallet's fills: a mean that is rounded at every step makes a round trip without result a win."""
    rows = f"SELECT event_id + c * 100000 AS event_id, * EXCLUDE (event_id, c) FROM '{FOLDER.replace('0.001', '0.1')}/events.parquet', (SELECT unnest(range(16)) AS c) WHERE user_id = 666 AND event_type = 'click'"
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = load().QUERIES["T1_pair_fills"](spark, str(tmp_path)).collect()
    want = con.sql(load().CHECKS["T1_pair_fills"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 50
