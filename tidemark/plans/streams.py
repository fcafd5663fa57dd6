"""Queries over record streams: metadata, filters, anchored windows, statistics, moving values, ranking, generators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.encoders import Multi, Scalar
from tidemark.operators import aggregate as agg
from tidemark.operators import groups, metrics, profile, ranking, records, windows
from tidemark.plans.catalog import EVENTS, EVENTS_SQL, RECORDS, events, query, table
from tidemark.sources import generators
from tidemark.sources.records import Field, read_records, shared_folder, write_records
from tidemark.spec import Aggregation, Interval, StreamSpec, micros

DAY = Interval.of(days=1)

#: Windows of a day, anchored at each user's first record: k is the window, w its start.
DAYS = f"""WITH ev AS ({EVENTS_SQL}), an AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS anchor FROM ev),
b AS (SELECT *, (epoch_us(ts) - epoch_us(anchor)) // 86400000000 AS k FROM an),
d AS (SELECT *, epoch_us(anchor) + k * 86400000000 AS w FROM b)"""


def _daily(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    df = events(spark, sf_dir).select("user_id", "ts", "event_id", *dict.fromkeys(fields))
    return agg.aggregate(df, EVENTS, Aggregation(DAY, tuple(fields.items()))).withColumn("w", micros("ts"))


@query(
    f"""{DAYS}, a AS (SELECT user_id, w, avg(x) * count(*) AS total, count(x) AS n FROM d GROUP BY ALL),
    p AS (SELECT *, lag(total) OVER u AS predicted FROM a WINDOW u AS (PARTITION BY user_id ORDER BY w))
    SELECT user_id, w, round(total, 8) AS total, round(predicted, 8) AS predicted, round(avg(abs(total - predicted)) OVER (PARTITION BY user_id ORDER BY w ROWS 9 PRECEDING), 8) AS aae FROM p"""
)
def daily_sum_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored daily sums, predicted by the day before, with the error of the last ten: the flagship query."""
    df = _daily(spark, sf_dir, x="sum").select("user_id", "ts", "event_id", "w", F.col("x").alias("total"))
    spec = StreamSpec(("user_id",), "w")
    df = df.withColumn("predicted", windows.shifted(spec, "total", 1))
    df = metrics.with_metric(df, spec, metrics.Metric("aae", "total", "predicted", window=10))
    return df.select("user_id", "w", *[F.round(c, 8).alias(c) for c in ("total", "predicted", "aae")])


@query("SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 60")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.filter_records(table(spark, sf_dir, "events"), {"value": {"type": "number", "min": 20, "max": 60}}).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.filter_records(table(spark, sf_dir, "events"), {"event_type": {"type": "category", "acceptValues": ["click", "error"]}}).select("event_id", "event_type")


@query("SELECT event_id, props FROM events WHERE contains(event_type, 'sign') OR contains(event_type, 'ew') OR contains(props, '7')")
def filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.contains_any(table(spark, sf_dir, "events"), {"event_type": ["sign", "ew"], "props": ["7"]}).select("event_id", "props")


@query(
    f"""WITH r AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS reset, row_number() OVER ({RECORDS}) - 1 AS rec_idx FROM events)
    SELECT event_id, rec_idx, CAST(reset AS INT) AS is_reset, CAST(sum(reset) OVER ({RECORDS}) - 1 AS BIGINT) AS sequence, (epoch_us(ts) + 719162 * 86400000000) // 3600000000 AS time_index FROM r"""
)
def record_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("reset", (F.col("event_id") % 50 == 0).cast("int"))
    spec = StreamSpec(EVENTS.keys, EVENTS.ts, EVENTS.order, reset="reset")
    df = records.with_index(records.with_record_meta(df, spec, Interval.of(hours=1)), spec)
    return df.select("event_id", "rec_idx", F.col("_reset").alias("is_reset"), F.col("_sequence").alias("sequence"), F.col("_time_index").alias("time_index"))


@query(
    f"""WITH s AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS k FROM events),
    l AS (SELECT *, lag(k) OVER ({RECORDS}) AS before FROM s)
    SELECT event_id, CAST(CASE WHEN before IS NULL OR before <> k THEN 1 ELSE 0 END AS INT) AS is_reset FROM l"""
)
def auto_reset_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.auto_reset(table(spark, sf_dir, "events"), EVENTS, DAY).select("event_id", F.col("_reset").alias("is_reset"))


@query(
    f"""WITH r AS (SELECT *, lag(event_type) OVER ({RECORDS}) AS before FROM events),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER ({RECORDS}) AS seq FROM r),
    d AS (SELECT *, value - lag(value) OVER w AS delta, row_number() OVER w AS pos FROM s WINDOW w AS (PARTITION BY user_id, seq ORDER BY ts, event_id))
    SELECT event_id, round(delta, 6) AS delta, CAST(pos = 2 AS INT) AS is_reset FROM d WHERE pos > 1"""
)
def delta_in_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StreamSpec(EVENTS.keys, EVENTS.ts, EVENTS.order, sequence="event_type")
    df = records.delta(records.with_record_meta(table(spark, sf_dir, "events"), spec), spec, "value")
    return df.select("event_id", F.round("delta", 6).alias("delta"), F.col("_reset").alias("is_reset"))


@query(f"SELECT event_id, pos FROM (SELECT event_id, row_number() OVER ({RECORDS}) - 1 AS pos FROM events) WHERE pos >= 5 AND pos < 20")
def row_range_5_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records.row_range(table(spark, sf_dir, "events"), EVENTS, 5, 20)
    return df.select("event_id", (F.row_number().over(EVENTS.records()) + 4).cast("long").alias("pos"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 3")
def last_3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_records(table(spark, sf_dir, "events"), EVENTS, 3).select("event_id")


@query(
    """WITH a AS (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT k, coalesce(n_events, 0) AS n_events, coalesce(n_orders, 0) AS n_orders FROM a FULL JOIN b USING (k)"""
)
def align_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return records.align(left, right, ["k"], [F.count("*").alias("n_events")], [F.count("*").alias("n_orders")]).select("k", n("n_events"), n("n_orders"))


@query(
    """WITH e AS (SELECT user_id AS k, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS n_orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1),
    c AS (SELECT c_custkey AS k, count(*) AS n_customers FROM customer GROUP BY 1), l AS (SELECT l_suppkey AS k, count(*) AS n_lines, min(l_shipdate) AS first FROM lineitem GROUP BY 1),
    a AS (SELECT k FROM e UNION SELECT k FROM o UNION SELECT k FROM c UNION SELECT k FROM l)
    SELECT k, coalesce(n_events, 0) AS n_events, coalesce(n_orders, 0) AS n_orders, coalesce(n_customers, 0) AS n_customers, coalesce(n_lines, 0) AS n_lines, total, dearest, epoch_us(first) AS first_us
    FROM a LEFT JOIN e USING (k) LEFT JOIN o USING (k) LEFT JOIN c USING (k) LEFT JOIN l USING (k)"""
)
def align_four_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lambda name, key, *more: table(spark, sf_dir, name).select(F.col(key).alias("k"), *more)
    inputs = {"events": keyed("events", "user_id", "value"), "orders": keyed("orders", "o_custkey", "o_totalprice"), "customers": keyed("customer", "c_custkey"), "lines": keyed("lineitem", "l_suppkey", "l_shipdate")}
    of = {"events": lambda c: [F.round(F.sum(c("value")), 4).alias("total")], "orders": lambda c: [F.max(c("o_totalprice")).alias("dearest")], "lines": lambda c: [micros(F.min(c("l_shipdate"))).alias("first_us")]}
    return groups.aligned(inputs, ["k"], of)


@query(
    """WITH o AS (SELECT o_custkey AS k, o_orderdate AS t, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
    e AS (SELECT user_id AS k, ts AS t, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT coalesce(o.k, e.k) AS k, r, o.x AS price, e.x AS kind FROM o FULL JOIN e USING (k, r)"""
)
def merge_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders beside the same user's events, the first with the first: both in order, through one exchange."""
    inputs = {"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", "o_totalprice"), "events": table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_id", "event_type")}
    in_order = {"orders": ["o_orderdate", "o_orderkey"], "events": ["ts", "event_id"]}

    def rows(key, parts):
        """Two numbers are held: how far each input has come."""
        at = {"orders": 0, "events": 0}
        for name, batch in parts:
            n = batch.num_rows
            places = pa.array(range(at[name] + 1, at[name] + n + 1), pa.int64())
            at[name] += n
            price, kind = (batch.column("o_totalprice"), pa.nulls(n, pa.string())) if name == "orders" else (pa.nulls(n, pa.float64()), batch.column("event_type"))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), places, price, kind], names=["k", "r", "price", "kind"])

    numbered = groups.merged(inputs, ["k"], in_order, rows, "k long, r long, price double, kind string")
    return numbered.groupBy("k", "r").agg(F.max("price").alias("price"), F.max("kind").alias("kind"))



@query(f"{DAYS} SELECT user_id, w, round(avg(x) * count(*), 4) AS sum_x, round(avg(value), 6) AS mean_value FROM d GROUP BY ALL")
def agg_sum_imputed_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, x="sum", value="mean").select("user_id", "w", F.round("x", 4).alias("sum_x"), F.round("value", 6).alias("mean_value"))


@query(f"{DAYS} SELECT user_id, w, min(x) AS min_x, max(value) AS max_value FROM d GROUP BY ALL")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, x="min", value="max").select("user_id", "w", F.col("x").alias("min_x"), F.col("value").alias("max_value"))


@query(
    f"""{DAYS} SELECT user_id, w, arg_min(x, (ts, event_id)) FILTER (x IS NOT NULL) AS first_x, arg_max(event_type, (ts, event_id)) AS last_type FROM d GROUP BY ALL"""
)
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, x="first", event_type="last").select("user_id", "w", F.col("x").alias("first_x"), F.col("event_type").alias("last_type"))


@query(
    f"""{DAYS}, c AS (SELECT user_id, w, event_type, count(*) AS n FROM d GROUP BY ALL)
    SELECT user_id, w, event_type AS mode_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1"""
)
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, event_type="mode").select("user_id", "w", F.col("event_type").alias("mode_type"))


@query(
    """WITH an AS (SELECT *, min(l_shipdate) OVER (PARTITION BY l_suppkey) AS anchor FROM lineitem),
    b AS (SELECT *, (epoch_us(l_shipdate) - epoch_us(anchor)) // (30 * 86400000000) AS k FROM an)
    SELECT l_suppkey, epoch_us(anchor) + k * 30 * 86400000000 AS w, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) AS price FROM b GROUP BY ALL"""
)
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StreamSpec(("l_suppkey",), "l_shipdate", ("l_orderkey", "l_linenumber"))
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    df = agg.aggregate(df, spec, Aggregation(Interval.of(days=30), (("l_extendedprice", "wmean:l_quantity"),)))
    return df.select("l_suppkey", micros("l_shipdate").alias("w"), F.round("l_extendedprice", 6).alias("price"))


@query(
    """WITH an AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_orderpriority) AS anchor FROM orders),
    b AS (SELECT *, (year(o_orderdate) * 12 + month(o_orderdate) - year(anchor) * 12 - month(anchor)) // 3 AS g FROM an),
    c AS (SELECT *, CASE WHEN anchor + to_months(CAST(g * 3 AS INT)) > o_orderdate THEN g - 1 ELSE g END AS k FROM b)
    SELECT o_orderpriority, epoch_us(anchor + to_months(CAST(k * 3 AS INT))) AS w, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM c GROUP BY ALL"""
)
def agg_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StreamSpec(("o_orderpriority",), "o_orderdate", ("o_orderkey",))
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", F.lit(1).alias("n"))
    df = agg.aggregate(df, spec, Aggregation(Interval.of(months=3), (("o_totalprice", "sum"), ("n", "sum"))))
    return df.select("o_orderpriority", micros("o_orderdate").alias("w"), F.col("n").cast("long").alias("n"), F.round("o_totalprice", 2).alias("total"))


@query(
    f"""WITH r AS (SELECT *, lag(event_type) OVER ({RECORDS}) AS before, row_number() OVER ({RECORDS}) AS pos FROM events),
    s AS (SELECT *, sum(CASE WHEN pos > 1 AND before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER ({RECORDS}) AS seq FROM r),
    b AS (SELECT *, min(ts) OVER (PARTITION BY user_id, seq) AS anchor FROM s),
    d AS (SELECT *, (epoch_us(ts) - epoch_us(anchor)) // 86400000000 AS k FROM b)
    SELECT user_id, CAST(seq AS BIGINT) AS seq, epoch_us(anchor) + k * 86400000000 AS w, round(max(value), 6) AS max_value FROM d GROUP BY ALL"""
)
def agg_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StreamSpec(EVENTS.keys, EVENTS.ts, EVENTS.order, sequence="event_type")
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    df = agg.aggregate(df, spec, Aggregation(DAY, (("value", "max"),)))
    return df.select("user_id", F.col("_seq").alias("seq"), micros("ts").alias("w"), F.round("value", 6).alias("max_value"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
    r AS (SELECT user_id, pos, x, us AS start, 1 AS k FROM e WHERE pos = 1 UNION ALL
    SELECT e.user_id, e.pos, e.x, CASE WHEN e.us < r.start THEN e.us ELSE r.start + (e.us - r.start) // 86400000000 * 86400000000 END, r.k + CAST(e.us < r.start OR e.us >= r.start + 86400000000 AS INT) FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
    SELECT user_id, start AS w, round(sum(x), 4) AS total FROM r GROUP BY user_id, k, start"""
)
def agg_in_record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of event_id, in which time goes back: each step back closes a window and anchors anew."""
    spec = StreamSpec(("user_id",), "ts", ("event_id",))
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    done = agg.aggregate_in_order(df, spec, Aggregation(DAY, (("value", lambda x, order: F.sum(x)),)))
    return done.select("user_id", micros("ts").alias("w"), F.round("value", 4).alias("total"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, event_type AS kind, event_id % 40 = 0 AS own FROM events),
    r AS (SELECT kind, pos, event_id, us AS start, 1 AS is_reset FROM e WHERE pos = 1 UNION ALL
    SELECT e.kind, e.pos, e.event_id, CASE WHEN e.own OR e.us < r.start THEN e.us ELSE r.start + (e.us - r.start) // 86400000000 * 86400000000 END,
    CAST(e.own OR e.us >= r.start + 86400000000 AS INT) FROM r JOIN e ON e.kind = r.kind AND e.pos = r.pos + 1)
    SELECT event_id, CAST(is_reset AS INT) AS is_reset FROM r"""
)
def auto_reset_in_record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of one event type in the order of event_id, with explicit resets: time goes back within them."""
    df = table(spark, sf_dir, "events").withColumn("own", (F.col("event_id") % 40 == 0).cast("int"))
    done = records.auto_reset_in_order(df, StreamSpec(("event_type",), "ts", ("event_id",), reset="own"), DAY)
    return done.select("event_id", F.col("_reset").alias("is_reset"))


@query(
    """SELECT 'acctbal' AS field, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS average, count(c_acctbal) AS n FROM customer
    UNION ALL SELECT 'nation', min(c_nationkey), max(c_nationkey), round(avg(c_nationkey), 6), count(c_nationkey) FROM customer"""
)
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return profile.field_ranges(df).select("field", "min", "max", F.round("average", 6).alias("average"), "n")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.category_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    """WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
    SELECT any_value(n) AS n, count(DISTINCT x) AS "distinct", min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean,
    min(CASE WHEN i = floor(n * 0.5) THEN x END) AS median, min(CASE WHEN i = floor(n * 0.01) THEN x END) AS p1, min(CASE WHEN i = floor(n * 0.99) THEN x END) AS p99,
    round((max(x) - min(x)) / (count(DISTINCT x) - 1), 6) AS mean_step FROM s"""
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = profile.numeric_profile(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return row.select("n", "distinct", "min", "max", F.round("mean", 4).alias("mean"), "median", "p1", "p99", F.round("mean_step", 6).alias("mean_step"))


@query("SELECT props AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def profile_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.string_profile(table(spark, sf_dir, "events"), "props")


@query(
    """SELECT min(quarter(ts)) <> max(quarter(ts)) AS season, min(dayofweek(ts)) <> max(dayofweek(ts)) AS day_of_week,
    min(isodow(ts) > 5) <> max(isodow(ts) > 5) AS weekend, min(hour(ts)) <> max(hour(ts)) AS time_of_day FROM events"""
)
def varying_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.varying_date_parts(table(spark, sf_dir, "events"), "ts")


@query(
    """SELECT 'event_type' AS field, count(*) AS total, count(event_type) AS n, count(DISTINCT event_type) AS "distinct" FROM events
    UNION ALL SELECT 'user_id', count(*), count(user_id), count(DISTINCT user_id) FROM events"""
)
def column_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entries(table(spark, sf_dir, "events").select("event_type", "user_id"))


@query(
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL)
    SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p_b_given_a, round(n / sum(n) OVER (PARTITION BY b), 6) AS p_a_given_b FROM c"""
)
def joint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return profile.joint_counts(df, "a", "b").withColumns({c: F.round(c, 6) for c in ("p_b_given_a", "p_a_given_b")})


@query(f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, round(avg(x) OVER ({RECORDS} ROWS 9 PRECEDING), 6) AS average FROM ev")
def moving_average_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(windows.moving_average(EVENTS, "x", 10), 6).alias("average"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER ({RECORDS}) AS pos FROM events),
    p AS (SELECT a.event_id, b.event_type, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 10 AND a.pos - 1 GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, event_type) AS k FROM p)
    SELECT r.event_id, m.event_type AS mode_type FROM r LEFT JOIN m ON r.event_id = m.event_id AND m.k = 1"""
)
def moving_mode_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", windows.moving_mode(EVENTS, "event_type", 10).alias("mode_type"))


@query(f"SELECT event_id, lag(value, 3) OVER ({RECORDS}) AS about FROM events")
def inference_shift_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("about"))
    return windows.shift_inferences(df, EVENTS, {"about": 3}).select("event_id", "about")


SLOPE = f"""WITH r AS (SELECT *, epoch_us(ts) / 3600000000.0 - 473000.0 AS h, count(*) OVER ({RECORDS} ROWS 9 PRECEDING) AS n FROM events)"""


def _hours() -> F.Column:
    return micros("ts") / 3600000000.0 - 473000.0


@query(f"{SLOPE} SELECT event_id, CASE WHEN n = 10 THEN round(regr_slope(value, h) OVER ({RECORDS} ROWS 9 PRECEDING), 4) END AS slope FROM r")
def regression_slope_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(windows.regression_slope(EVENTS, "value", _hours(), 10), 4).alias("slope"))


@query(f"{SLOPE} SELECT event_id, CASE WHEN n = 10 THEN round(exp(regr_slope(ln(value), h) OVER ({RECORDS} ROWS 9 PRECEDING)) - 1, 4) END AS growth FROM r")
def exponential_change_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("h", _hours())
    return df.select("event_id", F.round(windows.exponential_change(EVENTS, "value", "h", 10), 4).alias("growth"))


@query(
    f"""WITH r AS (SELECT *, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS c FROM events WINDOW w AS ({RECORDS}))
    SELECT event_id, round(avg(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 3) AS change, round(avg(abs(c)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 3) AS abs_change FROM r"""
)
def average_change_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.average_change(table(spark, sf_dir, "events"), EVENTS, "value", 10)
    return df.select("event_id", F.round("change", 3).alias("change"), F.round("abs_change", 3).alias("abs_change"))


@query(f"SELECT event_id, min(value) OVER w AS low, CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w ELSE min(value) OVER w + 1 END AS high FROM events WINDOW w AS ({RECORDS} ROWS UNBOUNDED PRECEDING)")
def running_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = windows.running_range(EVENTS, "value")
    return table(spark, sf_dir, "events").select("event_id", low.alias("low"), high.alias("high"))


@query(f"SELECT event_id, round(sum(value) OVER ({RECORDS} ROWS UNBOUNDED PRECEDING), 4) AS total, array_to_string(list(event_type) OVER ({RECORDS} ROWS 2 PRECEDING), ',') AS recent FROM events")
def cumulative_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(windows.cumulative(EVENTS, "value"), 4).alias("total"), F.array_join(windows.last_values(EVENTS, "event_type", 3), ",").alias("recent"))


@query(
    f"""WITH r AS (SELECT user_id, event_type AS bit, row_number() OVER ({RECORDS}) AS pos FROM events),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, bit ORDER BY pos) AS g FROM r)
    SELECT user_id, bit, min(pos) AS began, count(*) AS length FROM i GROUP BY user_id, bit, g"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("bits", F.array("event_type"))
    return windows.run_lengths(df, EVENTS, "bits")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders")
def sort_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range sort; the places come from the sorted partitions' sizes, not from one window."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return ranking.with_places(df, [F.col(c) for c in ("o_orderpriority", "o_orderdate", "o_orderkey")]).select("o_orderkey", "place")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query(
    """SELECT event_id, k AS place FROM (SELECT event_id, CASE WHEN u < 0.2 THEN 0 WHEN u < 0.5 THEN 1 ELSE 2 END AS k FROM (SELECT event_id, (event_id % 97) / 97.0 AS u FROM events))"""
)
def pick_from_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("p", F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)))
    return df.select("event_id", ranking.pick("p", F.col("event_id") % 97 / 97.0).alias("place"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER ({RECORDS}) - 1 AS pos FROM events)
    SELECT event_id, round(CASE WHEN pos BETWEEN 3 AND 6 THEN (value + 100) * 2 WHEN pos BETWEEN 7 AND 8 THEN value * 2 ELSE value END, 6) AS value FROM r"""
)
def anomalies_add_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = generators.add(table(spark, sf_dir, "events"), EVENTS, "value", 3, 6, 100.0)
    return generators.scale(df, EVENTS, "value", 3, 8, 2.0).select("event_id", F.round("value", 6).alias("value"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER ({RECORDS}) - 1 AS pos FROM events)
    SELECT user_id, event_id, CASE WHEN pos >= 10 THEN pos + 3 ELSE pos END AS rec_idx FROM r UNION ALL SELECT user_id, event_id, pos - 2 + 10 FROM r WHERE pos BETWEEN 2 AND 4"""
)
def anomalies_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.copy(table(spark, sf_dir, "events"), EVENTS, 2, 4, 10).select("user_id", "event_id", "rec_idx")


@query("SELECT event_id AS rec_idx, round(value + 5 + 2 * sin(event_id * (2 * pi() / 20)), 6) AS y FROM events")
def sine_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wave over the records' own values."""
    df = table(spark, sf_dir, "events").withColumnRenamed("event_id", "rec_idx")
    return df.select("rec_idx", F.round(F.col("value") + generators.sine(20.0, 2.0, 5.0), 6).alias("y"))


@query(f"WITH r AS (SELECT *, lag(value) OVER ({RECORDS}) AS b FROM events), d AS (SELECT event_id, value - b AS delta, row_number() OVER ({RECORDS}) AS pos FROM r) SELECT event_id, round(delta, 6) AS delta, pos = 2 AS begins FROM d WHERE pos > 1 AND delta BETWEEN -20 AND 20")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta, then a range of it; the successor of a sequence's first record bears the reset."""
    df = records.chain(table(spark, sf_dir, "events"), EVENTS, [lambda d, s: records.delta(d, s, "value"), lambda d, s: records.filter_records(d, {"delta": {"type": "number", "min": -20, "max": 20}})])
    return df.select("event_id", F.round("delta", 6).alias("delta"), (F.col("_reset") == 1).alias("begins"))


@query(f"WITH r AS (SELECT *, row_number() OVER ({RECORDS}) AS pos FROM events) SELECT event_id FROM r WHERE pos > 10 OR user_id % 3 = 0")
def after_bookmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream taken up again after its tenth record; streams without a bookmark are read whole."""
    df = table(spark, sf_dir, "events")
    mark = records.bookmark(records.row_range(df.where("user_id % 3 <> 0"), EVENTS, 0, 10), EVENTS)
    return records.after(df, EVENTS, mark).select("event_id")


@query(
    f"""WITH r AS (SELECT *, coalesce(event_id % 5 = 0, false) AS b, row_number() OVER ({RECORDS}) AS pos, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER ({RECORDS} ROWS UNBOUNDED PRECEDING) AS INT) AS block FROM events),
    f AS (SELECT a.user_id, a.event_id, coalesce(min(n.pos) FILTER (n.event_id % 4 <> 0 AND n.event_id % 3 <> a.event_id % 3), 1000000) AS fails, count(n.pos) AS ahead, a.pos FROM r a LEFT JOIN r n ON a.user_id = n.user_id AND a.block = n.block AND n.pos > a.pos AND n.pos <= a.pos + 6 GROUP BY ALL)
    SELECT event_id, CAST(least(fails - pos - 1, ahead) AS INT) AS extent FROM f"""
)
def prediction_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the next six inputs each output holds; an input is a residue, or one that every output holds."""
    spec = StreamSpec(EVENTS.keys, EVENTS.ts, EVENTS.order, reset="begins")
    own = lambda c: F.when(F.col("event_id") % 4 == 0, F.array(F.lit(9))).otherwise(F.array((F.col("event_id") % 3).cast("int"))).alias(c)
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", own("a"), F.array((F.col("event_id") % 3).cast("int"), F.lit(9)).alias("b"), (F.col("event_id") % 5 == 0).cast("int").alias("begins"))
    return windows.prediction_extent(df, spec, "a", "b", 6).select("event_id", "extent")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER ({RECORDS}) - 1 AS pos, first_value(epoch_us(ts)) OVER ({RECORDS}) AS t0, nth_value(epoch_us(ts), 2) OVER ({RECORDS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t1 FROM events)
    SELECT event_id, t0 + pos * coalesce(t1 - t0, 0) AS us FROM r"""
)
def respaced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records.with_index(table(spark, sf_dir, "events"), EVENTS)
    return generators.respaced(df, EVENTS, "rec_idx").select("event_id", micros("ts").alias("us"))


@query("SELECT event_id AS rec_idx, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 IN (1, 2) THEN event_id % 5 ELSE 4 + event_id // 5 * 4 + event_id % 5 END AS number, CAST(event_id % 5 = 4 AS INT) AS reset, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 7 END::INT AS on_bits FROM events")
def pattern_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of four patterns whose middle two are shared, a reset after each, in place of the events."""
    v = F.col("event_id")
    number = F.when(v % 5 == 4, None).when((v % 5).isin(1, 2), v % 5).otherwise(4 + F.floor(v / 5) * 4 + v % 5)
    rows = generators.in_patterns(table(spark, sf_dir, "events").select(v.alias("rec_idx"), number.alias("number")), 100, 7)
    return rows.select("rec_idx", "number", "reset", F.when(F.col("bits").isNotNull(), F.size("bits")).alias("on_bits"))


@query(
    """WITH n AS (SELECT 'value' AS field, 'number' AS kind, unnest(['n', 'distinct', 'min', 'max']) AS statistic, unnest([count(*), count(DISTINCT value), min(value), max(value)]) AS v FROM events),
    s AS (SELECT 'event_type', 'text', event_type, count(*) AS v FROM events GROUP BY event_type)
    SELECT field, kind, statistic, round(CAST(v AS DOUBLE), 6) AS value FROM n UNION ALL SELECT *  FROM s"""
)
def profile_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.profile(table(spark, sf_dir, "events").select("value", "event_type"), top=50)
    some = F.col("statistic").isin("n", "distinct", "min", "max") | (F.col("kind") == "text")
    return df.where(some).select("field", "kind", "statistic", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"WITH r AS (SELECT *, row_number() OVER ({RECORDS}) - 1 AS pos FROM events) SELECT user_id, CAST(least(5, greatest(0, least(max(pos) + 1, 30) - 2)) AS BIGINT) AS n, true AS within FROM r GROUP BY 1 HAVING max(pos) >= 2")
def sample_range_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each user's records 2 to 30, by seeded hash: how many there are, and whether all are of that range."""
    some = ranking.sample_range(records.with_index(table(spark, sf_dir, "events"), EVENTS), EVENTS, 5, 2, 30)
    return some.groupBy("user_id").agg(F.count("*").alias("n"), F.every(F.col("rec_idx").between(2, 29)).alias("within"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS x, epoch_us(ts) AS us, event_type AS type FROM events")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a record file with three header rows, and read back."""
    df = events(spark, sf_dir).select("event_id", "user_id", "x", "ts", "event_type")
    fields = [Field("event_id", "int"), Field("user_id", "int", "S"), Field("x", "float"), Field("ts", "datetime", "T"), Field("event_type", "string")]
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    write_records(df, fields, ["event_id"], path)
    return read_records(spark, path).select("event_id", "user_id", "x", micros("ts").alias("us"), F.col("event_type").alias("type"))


@query("SELECT user_id, count(*) AS n, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev FROM events GROUP BY 1")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.trace_summary(table(spark, sf_dir, "events"), ["user_id"], "value")
    return s.select("user_id", "n", "min", "max", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query("SELECT user_id AS part, v AS i, user_id * 10 + v * v AS x FROM (SELECT DISTINCT user_id FROM events), range(20) r(v)")
def function_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a function makes for each user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("part")).distinct()
    return generators.from_function(spark, lambda part: ((part, i, part * 10 + i * i) for i in range(20)), "part long, i long, x long", users)


@query(
    f"""WITH s AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS k FROM events), l AS (SELECT *, lag(k) OVER ({RECORDS}) AS before FROM s)
    SELECT event_id, CAST(CASE WHEN before IS NULL OR before <> k THEN 1 ELSE 0 END AS INT) AS is_reset, (epoch_us(ts) + 719162 * 86400000000) // 3600000000 AS time_index, array_to_string(range(CAST(floor((value + 2.5) / 5.0) AS INT), CAST(floor((value + 2.5) / 5.0) AS INT) + 21), ' ') AS bits
    FROM l WHERE value BETWEEN 5 AND 300"""
)
def sensor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor: records with a reset a day, those in a range of values, encoded."""
    in_range = lambda d, s: records.filter_records(d, {"value": {"type": "number", "min": 5, "max": 300}})
    sensor = records.Sensor(EVENTS, Multi({"value": ("value", Scalar(21, 0, 500, n=121))}), (lambda d, s: records.auto_reset(d, s, DAY), in_range), Interval.of(hours=1))
    done = sensor.sense(table(spark, sf_dir, "events"))
    return done.select("event_id", F.col("_reset").alias("is_reset"), F.col("_time_index").alias("time_index"), F.array_join(F.col("bits").cast("array<string>"), " ").alias("bits"))
