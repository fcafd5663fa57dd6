"""Queries against their SQL on values that the small tables lack: zeros, and values beyond an encoder's range."""

import datetime as dt
import math

import pytest

from tests.oracle import differences, sql_rows
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of two users; some values are 0, one is near the end of 0 to 500, and some are beyond it."""
    base = tmp_path_factory.mktemp("beyond")
    odd = {5: 0.0, 20: 498.7, 21: 560.21, 34: 516.0, 45: 612.5, 46: 7000.0}
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 2 + 1, "abc"[i % 3], odd.get(i, 1.0 + i * 7.3 % 90), "{}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{base}/events.parquet")
    for table in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        spark.range(1).coalesce(1).write.parquet(f"{base}/{table}.parquet")
    return str(base)


def _sql(name):
    return catalog.oracle_sql()[name]


@pytest.fixture(autouse=True)
def folders(monkeypatch):
    """DuckDB reads folders of Parquet by a pattern."""
    from tests import oracle

    connect = oracle.duckdb.connect

    class Reads:
        def __init__(self):
            self.con = connect()

        def execute(self, sql):
            return self.con.execute(sql.replace(".parquet'", ".parquet/*.parquet'"))

    monkeypatch.setattr(oracle.duckdb, "connect", Reads)


ENCODED = ["monitor_traces", "monitor_metrics", "sequence_cells", "pooler_by_density", "pooler_inference", "predicted_cells", "segment_activity", "softmax_inference", "knn_overlaps", "saturation_levels", "sdr_noise"]


@pytest.mark.parametrize("name", ENCODED)
def test_values_beyond_the_range_keep_their_places(spark, folder, name):
    assert not differences(catalog.queries()[name](spark, folder), _sql(name), folder)


def test_growth_over_a_zero_is_not_a_number(spark, folder):
    names, rows = sql_rows(_sql("exponential_change_10"), folder)
    want = {r[names.index("event_id")]: r[names.index("growth")] for r in rows}
    got = {r["event_id"]: r["growth"] for r in catalog.queries()["exponential_change_10"](spark, folder).collect()}
    same = lambda a, b: a is b is None or (a is not None and b is not None and (a == b or math.isnan(a) and math.isnan(b)))
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    assert sum(v is not None and math.isnan(v) for v in got.values()) == 3  # the zero is the third of its user's records


def test_rows_are_exchanged_for_no_overlap(spark, folder):
    """Pairs of patterns and queries are small, so they go to the rows and no row is written for a join."""
    df = catalog.queries()["knn_overlaps"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
