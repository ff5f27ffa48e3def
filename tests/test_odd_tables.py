"""Queries against their SQL on tables with values that the given ones seldom have."""

import datetime as dt
import sys
import pathlib

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import canon  # noqa: E402

T0 = dt.datetime(2024, 1, 1)


def equals_its_sql(spark, folder, name, table, rows, ddl):
    """The query and its SQL over one table of the given rows."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    mine = canon(entry.queries()[name](spark, str(folder)).toPandas())
    theirs = canon(con.execute(entry.oracle_sql()[name]).df())
    return mine.equals(theirs) and len(mine) > 0


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(n, value, every=dt.timedelta(minutes=1), kinds=("view", "click")):
    return [(i, T0 + every * i, i % 7, kinds[i % len(kinds)], value(i), "{}") for i in range(n)]


@pytest.mark.parametrize("name", ["P1_P2_parse_ticks", "P1_parse_errors", "P1_P2_bad_values", "S7_S8_stream_with_dead_letters", "S8_written_rows", "X4_counters"])
def test_values_of_zero(spark, tmp_path, name):
    assert equals_its_sql(spark, tmp_path, name, "events", events(200, lambda i: 0.0 if i % 3 == 0 else i / 4), EVENTS)
