"""The registry of queries: each is a function of (spark, sf_dir), with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.spec import StreamSpec

Query = Callable[[SparkSession, str], DataFrame]

#: The event stream: one sequence of records a user.
EVENTS = StreamSpec(("user_id",), "ts", ("event_id",))
#: The same record order in SQL.
RECORDS = "PARTITION BY user_id ORDER BY ts, event_id"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def register(name: str, f: Query, sql: str | None = None) -> None:
    _queries[name] = f
    if sql:
        _sql[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, with x: value, missing in every seventh record."""
    return table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value")))


#: The same in SQL.
EVENTS_SQL = "SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events"


def _all() -> None:
    from tidemark.plans import coding, scoring, streamed, streams, traces  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)
