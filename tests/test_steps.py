"""Queries over training steps against their SQL, on events that lie within a second of a step's end."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shiftloom.plans import catalog

from .test_queries import rows


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """A folder with events: many at .4, .5 and .6 seconds before or after the ends of steps, and some between."""
    folder = str(tmp_path_factory.mktemp("events"))
    start = dt.datetime(2024, 1, 1)
    at = [start + dt.timedelta(days=3 * step, seconds=s) for step in range(5) for s in (-1.5, -0.6, -0.5, -0.4, 0.4, 0.5, 0.6, 1.5, 3600)]
    table = [(t, u, f'{{"k": {(k * 7 + u) % 13}}}') for k, t in enumerate(at * 3) for u in range(6)]
    ts, user, props = zip(*table, strict=True)
    pq.write_table(pa.table({"event_id": pa.array(range(len(ts))), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(user, pa.int64()), "props": pa.array(props)}), f"{folder}/events.parquet")
    return folder


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    expected = rows(con.execute(catalog.ORACLE_SQL[name]).df())
    assert expected and rows(catalog.QUERIES[name](spark, folder).toPandas()) == expected


def test_onset_curve_at_the_ends_of_steps(spark, events):
    same(spark, events, "onset_curve")


def test_step_category_at_the_ends_of_steps(spark, events):
    same(spark, events, "step_category")


def test_step_metrics_at_the_ends_of_steps(spark, events):
    same(spark, events, "step_metrics")
