"""Queries over values: encoders, sparse arrays, text forms, mathematics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import encoders, maths, sdr, text
from tidemark.operators.windows import stability
from tidemark.plans.catalog import EVENTS, EVENTS_SQL, RECORDS, events, query, table

SCALAR = encoders.Scalar(21, 0, 500, n=121)
PERIODIC = encoders.Scalar(5, 0, 500, periodic=True, n=50)
LOG = encoders.Log(5, 0.1, 1000, n=45)
TYPES = encoders.Category(3, ("click", "error", "purchase", "view"))
DATES = encoders.Date(season=3, day_of_week=3, weekend=3, time_of_day=5)

#: Buckets of SCALAR (5.0 a step) and of PERIODIC (10.0 a step), in SQL.
BUCKET, AROUND = "CAST(floor((CASE WHEN x > 500 THEN 500.0 WHEN x < 0 THEN 0.0 ELSE x END + 2.5) / 5.0) AS INT)", "CAST(floor((x % 500) * 50 / 500.0) AS INT)"


def _text(bits) -> F.Column:
    return F.array_join(bits.cast("array<string>"), " ")


@query(f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, CASE WHEN x IS NULL THEN '' ELSE array_to_string(range({BUCKET}, {BUCKET} + 21), ' ') END AS bits, {BUCKET} AS bucket FROM ev")
def enc_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", _text(SCALAR.encode(F.col("x"))).alias("bits"), SCALAR.bucket(F.col("x")).alias("bucket"))


@query(f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, CASE WHEN x IS NULL THEN '' ELSE array_to_string(list_sort([({AROUND} + i + 48) % 50 FOR i IN range(5)]), ' ') END AS bits FROM ev")
def enc_scalar_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", _text(PERIODIC.encode(F.col("x"))).alias("bits"))


@query(f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, CASE WHEN x IS NULL THEN NULL ELSE CAST(floor((log10(greatest(least(x, 1000.0), 0.1)) + 1 + 0.05) / 0.1) AS INT) END AS bucket FROM ev")
def enc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", LOG.bucket(F.col("x")).alias("bucket"))


@query(
    """WITH b AS (SELECT event_id, coalesce(list_position(['click', 'error', 'purchase', 'view'], event_type), 0) AS b FROM events)
    SELECT event_id, array_to_string(range(b * 3, b * 3 + 3), ' ') AS bits, CASE b WHEN 0 THEN '<UNKNOWN>' WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE 'view' END AS back FROM b"""
)
def enc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", _text(TYPES.encode(c)).alias("bits"), TYPES.value_of(TYPES.bucket(c)).alias("back"))


@query(
    """SELECT event_id, CAST(dayofyear(ts) - 1 AS DOUBLE) AS season, round(isodow(ts) - 1 + (hour(ts) + minute(ts) / 60.0) / 24.0, 6) AS day_of_week,
    CAST((isodow(ts) > 5 OR (isodow(ts) = 5 AND hour(ts) > 18)) AS DOUBLE) AS weekend, round(hour(ts) + minute(ts) / 60.0, 6) AS time_of_day FROM events"""
)
def enc_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = encoders.date_scalars(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *[F.round(parts[k], 6).alias(k) if k != "weekend" else parts[k].alias(k) for k in ("season", "day_of_week", "weekend", "time_of_day")])


def _round_bits(scalar: encoders.Scalar, x: str, at: int) -> str:
    """A periodic scalar's bits in SQL, moved by at."""
    n, span, half = scalar.width, scalar.high - scalar.low, (scalar.w - 1) // 2
    return f"list_sort([{at} + (CAST(floor((({x}) % {span}) * {n} / {span}.0) AS INT) - {half} + i + {n}) % {n} FOR i IN range({scalar.w})])"


_HOURS = "(hour(ts) + minute(ts) / 60.0)"
_D = DATES.parts
_AT = {"season": 0, "day_of_week": _D["season"].width, "weekend": _D["season"].width + _D["day_of_week"].width, "time_of_day": _D["season"].width + _D["day_of_week"].width + _D["weekend"].width}


@query(
    f"""SELECT event_id, array_to_string(list_concat(list_concat({_round_bits(_D["season"], "dayofyear(ts) - 1", 0)}, {_round_bits(_D["day_of_week"], f"isodow(ts) - 1 + {_HOURS} / 24.0", _AT["day_of_week"])}),
    list_concat(range({_AT["weekend"]} + w, {_AT["weekend"]} + w + 3), {_round_bits(_D["time_of_day"], _HOURS, _AT["time_of_day"])})), ' ') AS bits
    FROM (SELECT *, CASE WHEN isodow(ts) > 5 OR (isodow(ts) = 5 AND hour(ts) > 18) THEN 3 ELSE 0 END AS w FROM events)"""
)
def enc_date_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the parts' bits side by side."""
    return table(spark, sf_dir, "events").select("event_id", _text(DATES.encode(F.col("ts"))).alias("bits"))


@query(
    f"""WITH ev AS ({EVENTS_SQL}), b AS (SELECT event_id, x, coalesce(list_position(['click', 'error', 'purchase', 'view'], event_type), 0) AS c FROM ev)
    SELECT event_id, array_to_string(list_concat(CASE WHEN x IS NULL THEN [] ELSE range({BUCKET}, {BUCKET} + 21) END, range(121 + c * 3, 124 + c * 3)), ' ') AS bits FROM b"""
)
def enc_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    multi = encoders.Multi({"a_value": ("x", SCALAR), "b_type": ("event_type", TYPES)})
    return events(spark, sf_dir).select("event_id", _text(multi.encode()).alias("bits"))


@query(
    f"""WITH r AS (SELECT event_id, value, min(value) OVER w AS low, max(value) OVER w AS top FROM events WINDOW w AS ({RECORDS} ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT *, CASE WHEN top > low THEN top ELSE low + 1 END AS high FROM r), s AS (SELECT *, (high - low) / 100 AS step FROM h),
    b AS (SELECT event_id, CAST(floor((value - low + step / 2) / step) AS INT) AS b FROM s) SELECT event_id, array_to_string(range(b, b + 21), ' ') AS bits FROM b"""
)
def enc_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _text(encoders.adaptive(EVENTS, "value", 21, 121)).alias("bits"))


@query(
    f"""WITH d AS (SELECT event_id, value - lag(value) OVER ({RECORDS}) AS x FROM events), c AS (SELECT event_id, CASE WHEN x IS NOT NULL THEN greatest(least(x, 500.0), -500.0) END AS x FROM d)
    SELECT event_id, CASE WHEN x IS NULL THEN '' ELSE array_to_string(range(CAST(floor((x + 505.0) / 10.0) AS INT), CAST(floor((x + 505.0) / 10.0) AS INT) + 21), ' ') END AS bits FROM c"""
)
def enc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.col("value") - F.lag("value").over(EVENTS.records())
    own = encoders.Scalar(21, -500, 500, n=121)
    return table(spark, sf_dir, "events").withColumn("change", change).select("event_id", _text(own.encode(F.col("change"))).alias("bits"))


@query(f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, round({BUCKET} * 5.0, 6) AS back, round({BUCKET} * 5.0, 6) AS decoded, round(1 - abs({BUCKET} * 5.0 - x) / 500.0, 6) AS close FROM ev WHERE x IS NOT NULL")
def bucket_value_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    back = SCALAR.value_of(SCALAR.bucket(x))
    df = events(spark, sf_dir).where("x is not null")
    return df.select("event_id", F.round(back, 6).alias("back"), F.round(SCALAR.decode(SCALAR.encode(x)), 6).alias("decoded"), F.round(SCALAR.closeness(x, back), 6).alias("close"))


@query()
def enc_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random distributed scalars; tests hold their overlaps against the law."""
    df = encoders.Distributed(5.0).encode_in(events(spark, sf_dir), "x", "bits")
    return df.select("event_id", _text(F.array_sort("bits")).alias("bits"))


@query(
    """WITH c AS (SELECT DISTINCT event_type FROM events), h AS (SELECT event_type, b, row_number() OVER (PARTITION BY event_type ORDER BY md5('1/' || event_type || '/' || b)) AS r FROM c, range(200) x(b))
    SELECT event_type, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS bits FROM h WHERE r <= 9 GROUP BY 1"""
)
def enc_category_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoders.category_table(table(spark, sf_dir, "events"), "event_type", 200, 9)
    return found.select("event_type", _text(F.col("bits")).alias("bits"))


@query(
    """WITH c AS (SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS x, event_id % 40 AS y FROM events), p AS (SELECT event_id, md5((x + i) || '/' || (y + j)) AS h FROM c, range(-3, 4) a(i), range(-3, 4) b(j)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY h DESC) AS r FROM p), b AS (SELECT DISTINCT event_id, CAST('0x' || substr(h, 18, 15) AS BIGINT) % 500 AS b FROM r WHERE r <= 15)
    SELECT event_id, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS bits FROM b GROUP BY 1"""
)
def enc_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = encoders.coordinate([F.floor(F.col("value") / 10), F.col("event_id") % 40], 3, 15, 500)
    return table(spark, sf_dir, "events").select("event_id", _text(bits).alias("bits"))


@query(
    """SELECT event_id, CAST(floor(6378137.0 * radians(lon) / 30) AS BIGINT) AS gx, CAST(floor(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) / 30) AS BIGINT) AS gy
    FROM (SELECT event_id, (event_id % 360) - 180.0 + 0.013 AS lon, (event_id % 160) - 80.0 + 0.017 AS lat FROM events)"""
)
def geo_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("event_id") % 360 - F.lit(180.0) + 0.013, F.col("event_id") % 160 - F.lit(80.0) + 0.017
    gx, gy = encoders.mercator(lon, lat, 30)
    return table(spark, sf_dir, "events").select("event_id", gx.alias("gx"), gy.alias("gy"))


PAIRS = f"""WITH ev AS (SELECT *, value AS x FROM events), e AS (SELECT *, range({BUCKET}, {BUCKET} + 21) AS a FROM ev), p AS (SELECT *, lag(a) OVER ({RECORDS}) AS b FROM e)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("a", SCALAR.encode(F.col("value")))
    return df.withColumn("b", F.lag("a").over(EVENTS.records()))


@query(
    f"""{PAIRS} SELECT event_id, len(list_intersect(a, b)) AS common, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS either,
    array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ' ') AS only_a FROM p WHERE b IS NOT NULL"""
)
def sdr_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).where("b is not null").select("event_id", sdr.overlap(a, b).cast("long").alias("common"), _text(sdr.union(a, b)).alias("either"), _text(sdr.difference(a, b)).alias("only_a"))


@query(f"{PAIRS} SELECT event_id, round(len(list_intersect(a, b)) / 21.0, 6) AS stable FROM p WHERE b IS NOT NULL")
def sdr_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir).withColumn("stable", F.round(stability(EVENTS, "a"), 6))
    return df.where("b is not null").select("event_id", "stable")


@query(f"{PAIRS} SELECT event_id, CAST((21 - coalesce(len(list_intersect(a, b)), 0)) / 21.0 AS DECIMAL(9, 6))::DOUBLE AS score FROM p")
def raw_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.anomaly import with_raw_score

    df = with_raw_score(_pairs(spark, sf_dir), EVENTS, "a")
    return df.select("event_id", F.round("raw_score", 6).alias("score"))


@query(
    f"""WITH ev AS (SELECT event_id, value AS x FROM events) SELECT event_id, repeat('0', {BUCKET}) || repeat('1', 21) || repeat('0', 100 - {BUCKET}) AS written, array_to_string(range({BUCKET}, {BUCKET} + 21), ' ') AS back FROM ev"""
)
def sdr_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", text.format_bits(SCALAR.encode(F.col("value")), 121).alias("written"))
    return df.select("event_id", "written", _text(text.parse_bits(F.col("written"))).alias("back"))


@query(r"SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), chr(10), '\n'), chr(9), '\t'), ',', chr(9)) AS written, coalesce(text, '') AS back FROM documents")
def escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", text.escape(F.col("text")).alias("written"))
    return df.select("doc_id", "written", text.unescape(F.col("written")).alias("back"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS written, epoch_us(ts) AS us, epoch_us(date_trunc('minute', ts)) AS short_us FROM events")
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", text.format_timestamp(F.col("ts")).alias("written"), F.date_format("ts", "MM/dd/yyyy HH:mm").alias("short"))
    return df.select("event_id", "written", F.unix_micros(text.parse_timestamp(F.col("written"))).alias("us"), F.unix_micros(text.parse_timestamp(F.col("short"))).alias("short_us"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c, (SELECT sum(n) AS t FROM c)")
def entropy_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maths.entropy(table(spark, sf_dir, "events"), "event_type").select(F.round("entropy", 6).alias("entropy"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


ROC = """WITH j AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
c AS (SELECT n_chars AS threshold, sum(quality) AS p, count(*) - sum(quality) AS q FROM j GROUP BY 1),
r AS (SELECT threshold, sum(q) OVER w / sum(q) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{ROC} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def roc_curve_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maths.roc_curve(_judged(spark, sf_dir), "quality", "n_chars").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"{ROC}, l AS (SELECT fpr, tpr, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(tpr) OVER w, 0) AS t0 FROM r WINDOW w AS (ORDER BY fpr, tpr)) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM l")
def auc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maths.auc(_judged(spark, sf_dir), "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


@query(
    """WITH v AS (SELECT event_id, [value / 100, 1.0, 0.5] AS x FROM events), e AS (SELECT event_id, value / 100 AS a, exp(value / 100) + exp(1.0) + exp(0.5) AS t FROM events)
    SELECT event_id, round(exp(a) / t, 6) AS p, round(a - ln(t), 6) AS log_p FROM e"""
)
def softmax_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(F.col("value") / 100, F.lit(1.0), F.lit(0.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(maths.softmax(x)[0], 6).alias("p"), F.round(maths.log_normalised(x)[0], 6).alias("log_p"))


@query("SELECT event_id, round(ln(exp(value / 100) + exp(1.0)), 6) AS s, round(ln(exp(value / 100 + 1) - exp(value / 100)), 6) AS d FROM events")
def log_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", F.round(maths.log_sum_exp(a, F.lit(1.0)), 6).alias("s"), F.round(maths.log_diff_exp(a + 1, a), 6).alias("d"))


@query(
    """WITH c AS (SELECT event_id, event_id % 60 AS i FROM events), g AS (SELECT event_id, i // 10 AS r, i % 10 AS c FROM c)
    SELECT event_id, string_agg(CAST(y * 10 + x AS VARCHAR), ' ' ORDER BY y * 10 + x) AS near FROM g, range(6) a(y), range(10) b(x) WHERE abs(y - r) <= 1 AND abs(x - c) <= 1 GROUP BY 1"""
)
def topology_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _text(F.array_sort(maths.neighbourhood(F.col("event_id") % 60, 1, [6, 10]))).alias("near"))


@query(
    f"""WITH ev AS (SELECT event_id, value AS x, coalesce(list_position(['click', 'error', 'purchase', 'view'], event_type), 0) AS c, event_type FROM events)
    SELECT event_id, array_to_string([CAST(c AS VARCHAR), CAST({BUCKET} AS VARCHAR)], ' ') AS scalars, round({BUCKET} * 5.0, 6) AS x, CASE WHEN c > 0 THEN event_type ELSE '<UNKNOWN>' END AS kind FROM ev"""
)
def composite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoders from definitions: the fields' buckets, and what their bits decode to."""
    multi = encoders.Multi.of({"kind": {"fieldname": "event_type", "type": "category", "w": 3, "categories": TYPES.categories}, "x": {"fieldname": "value", "type": "scalar", "w": 21, "low": 0, "high": 500, "n": 121}, "none": None})
    df = table(spark, sf_dir, "events").withColumn("back", multi.decode(multi.encode()))
    return df.select("event_id", F.array_join(multi.scalars().cast("array<int>").cast("array<string>"), " ").alias("scalars"), F.round("back.x", 6).alias("x"), "back.kind")


@query(f"WITH ev AS (SELECT event_id, value AS x FROM events), b AS (SELECT event_id, CAST(floor((x % 500) * 50 / 500.0) AS INT) AS b FROM ev) SELECT event_id, round(b * 10.0 + 5.0, 6) AS decoded FROM b")
def periodic_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(PERIODIC.decode(PERIODIC.encode(F.col("value"))), 6).alias("decoded"))


@query(
    f"""WITH ev AS (SELECT event_id, value AS x FROM events), n AS (SELECT event_id, {BUCKET} AS b FROM ev), v AS (SELECT event_id, k, CAST(len(list_filter(range(b, b + 21), lambda p: p % 3 <> 1 AND p BETWEEN k AND k + 20)) AS INT) AS n FROM n, range(101) r(k))
    SELECT event_id, round(arg_max(k, (n, -k)) * 5.0, 6) AS decoded FROM v GROUP BY 1"""
)
def decode_partial_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which a third of the bits is missing: the bucket with the most of them, the least on a tie."""
    bits = F.filter(SCALAR.encode(F.col("value")), lambda b: b % 3 != 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(SCALAR.decode(bits), 6).alias("decoded"))


@query(
    f"""WITH d AS (SELECT event_id, value - lag(value) OVER ({RECORDS}) AS x FROM events), c AS (SELECT event_id, CASE WHEN x IS NOT NULL THEN greatest(least(x, 100.0), -100.0) END AS x FROM d)
    SELECT event_id, CASE WHEN x IS NULL THEN '' ELSE array_to_string(range(CAST(floor((x + 101.0) / 2.0) AS INT), CAST(floor((x + 101.0) / 2.0) AS INT) + 21), ' ') END AS bits FROM c"""
)
def enc_scalar_space_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _text(encoders.scalar_space(EVENTS, "value", 21, 121, "delta")).alias("bits"))


@query("SELECT event_id, CAST(greatest(round(s * 2.0 / 30 / 2 * 1.5), 2) AS INT) AS radius FROM (SELECT event_id, value / 3 AS s FROM events)")
def geo_speed_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", encoders.speed_radius(F.col("value") / 3, 2.0, 30.0, 21).alias("radius"))


@query("SELECT event_id, array_to_string([event_id % 7, 7 + event_id % 11, 30], ' ') AS bits, CASE WHEN greatest(abs(value), 100) = 0 THEN 1.0 ELSE round(greatest(0, 1 - abs(value - 100) / greatest(abs(value), 100)), 6) END AS close FROM events")
def pass_through_and_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.array((7 + F.col("event_id") % 11).cast("int"), (F.col("event_id") % 7).cast("int"), F.lit(30))
    return table(spark, sf_dir, "events").select("event_id", _text(encoders.PassThrough(40, 3).encode(bits)).alias("bits"), F.round(encoders.closeness(F.col("value"), F.lit(100.0)), 6).alias("close"))


@query(
    f"""{PAIRS} SELECT event_id, len(list_intersect(a, b)) / 21.0 AS hits, (21 - len(list_intersect(a, b))) / 21.0 AS extra, (21 - len(list_intersect(a, b))) / 21.0 AS missing,
    len(list_intersect(a, b)) AS met, 21 - len(list_intersect(a, b)) AS failed, 21 - len(list_intersect(a, b)) AS surprising FROM p WHERE b IS NOT NULL"""
)
def sdr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the last record's bits foretell this one's."""
    m, t = sdr.match(F.col("a"), F.col("b")), sdr.transitions(F.col("a"), F.col("b"))
    df = _pairs(spark, sf_dir).where("b is not null").select("event_id", m.alias("m"), t.alias("t"))
    return df.select("event_id", "m.hits", "m.extra", "m.missing", F.size("t.predicted_active").cast("long").alias("met"), F.size("t.predicted_inactive").cast("long").alias("failed"), F.size("t.unpredicted_active").cast("long").alias("surprising"))


@query(f"{PAIRS} SELECT event_id, array_to_string(list_sort(list_distinct([c // 4 FOR c IN a])), ' ') AS columns, array_to_string(range((event_id % 30) * 4, (event_id % 30) * 4 + 4), ' ') AS cells, array_to_string([c FOR c IN a IF c % 2 = 0], ' ') AS learned FROM p")
def cells_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    evens = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: i * 2)
    return _pairs(spark, sf_dir).select("event_id", _text(sdr.columns_of(F.col("a"), 4)).alias("columns"), _text(sdr.cells_of(F.col("event_id") % 30, 4)).alias("cells"), _text(sdr.learned_only(F.col("a"), evens)).alias("learned"))


@query("SELECT event_id, event_type = 'click' AS said, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) / 4 END AS x, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS n, array_to_string([event_id % 7, event_id % 11], ' ') AS list, repeat('.', CAST(event_id % 9 AS INT)) || '*' || repeat('.', CAST(8 - event_id % 9 AS INT)) AS drawn FROM events")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are text: booleans, nullable numbers, lists; and bits drawn."""
    none = F.col("event_id") % 5 == 0
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "click", F.element_at(F.array(F.lit("True"), F.lit("t"), F.lit("1")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise("F").alias("b"),
        F.when(none, "None").otherwise((F.col("event_id") / 4).cast("string")).alias("f"), F.when(none, F.when(F.col("event_id") % 2 == 0, "NULL").otherwise("None")).otherwise(F.col("event_id").cast("string")).alias("i"),
        F.concat_ws("  ", F.col("event_id") % 7, F.col("event_id") % 11).alias("l"),
    )
    bits = F.array((F.col("event_id") % 9).cast("int"))
    return df.select("event_id", text.parse_bool(F.col("b")).alias("said"), text.parse_float(F.col("f")).alias("x"), text.parse_int(F.col("i")).alias("n"), text.format_ints(text.parse_ints(F.col("l"))).alias("list"), text.draw_bits(bits, 9).alias("drawn"))


@query(
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL, false) AS fits, CAST(event_id % 6 * 10 + event_id % 10 AS BIGINT) AS back,
    array_to_string([CASE WHEN i = event_id % 6 THEN 1 ELSE 0 END FOR i IN range(6)], '') AS hot, round(ln(1.0000000001 - (event_id % 100) / 100.0) / -23.02585084720009, 6) AS scaled FROM events"""
)
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a schema, coordinates to an index, an indicator vector, a likelihood's log scale."""
    back = maths.index_of(F.array(F.col("event_id") % 6, F.col("event_id") % 10), [6, 10])
    hot = F.array_join(maths.one_hot(F.col("event_id") % 6, 6).cast("array<string>"), "")
    return table(spark, sf_dir, "events").select("event_id", text.is_json_of(F.col("props"), "k long").alias("fits"), back.alias("back"), hot.alias("hot"), F.round(maths.log_likelihood(F.col("event_id") % 100 / 100.0), 6).alias("scaled"))


@query(
    """SELECT event_id, string_agg(CAST(y * 10 + x AS VARCHAR), ' ' ORDER BY y * 10 + x) AS near FROM (SELECT event_id, (event_id % 60) // 10 AS r, event_id % 10 AS c FROM events), range(6) a(y), range(10) b(x)
    WHERE least((y - r + 6) % 6, (r - y + 6) % 6) <= 1 AND least((x - c + 10) % 10, (c - x + 10) % 10) <= 1 GROUP BY 1"""
)
def wrapping_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _text(F.array_sort(maths.neighbourhood(F.col("event_id") % 60, 1, [6, 10], wrap=True))).alias("near"))


@query(
    """WITH p AS (SELECT event_id, [(event_id % 5 + 1) / 10.0, 0.2, 0.8 - (event_id % 5 + 1) / 10.0] AS p, [2.0, 1.0, 0.5] AS a FROM events)
    SELECT event_id, round(list_sum([CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END FOR v IN p]), 6) AS entropy, round(list_sum([CASE WHEN p[i] > 0 THEN -p[i] * ln(p[i] / a[i]) ELSE 0 END FOR i IN [1, 2, 3]]), 6) AS differential,
    round(p[1] * p[2] * p[3], 8) AS product, list_max(p) > 0.45 AS some, list_max(p) < 0.65 AS every FROM p"""
)
def array_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("event_id") % 5 + 1) / 10.0
    df = table(spark, sf_dir, "events").select("event_id", F.array(first, F.lit(0.2), 0.8 - first).alias("p"))
    areas = F.array(F.lit(2.0), F.lit(1.0), F.lit(0.5))
    return df.select("event_id", F.round(maths.array_entropy(F.col("p")), 6).alias("entropy"), F.round(maths.differential_entropy(F.col("p"), areas), 6).alias("differential"), F.round(maths.product(F.col("p")), 8).alias("product"), maths.any_of(F.transform("p", lambda v: v > 0.45)).alias("some"), maths.all_of(F.transform("p", lambda v: v < 0.65)).alias("every"))


@query("WITH v AS (SELECT event_id, event_id % 30 + 1 AS n, event_id % 31 AS k FROM events) SELECT event_id, CAST(round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))) AS DOUBLE) AS ways FROM v WHERE k <= n")
def binomial_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30 + 1).alias("n"), (F.col("event_id") % 31).alias("k"))
    return df.where("k <= n").select("event_id", maths.choose(F.col("n"), F.col("k")).alias("ways"))


@query(
    """WITH v AS (SELECT event_id, value AS x, value / 600 AS u, CAST(floor(value / 10) AS DOUBLE) AS k FROM events)
    SELECT event_id, round(-0.5 * pow((x - 50) / 20, 2) - ln(20) - 0.5 * ln(2 * pi()), 6) AS normal, round(2 * ln(0.05) - lgamma(2) + ln(x) - 0.05 * x, 6) AS gamma,
    round(lgamma(5) - lgamma(2) - lgamma(3) + ln(u) + 2 * ln(1 - u), 6) AS beta, round(k * ln(4) - 4 - lgamma(k + 1), 6) AS poisson, round(CASE WHEN k <= 9 THEN lgamma(10) - lgamma(k + 1) - lgamma(10 - k) + k * ln(0.3) + (9 - k) * ln(0.7) END, 6) AS binomial, round(ln(0.2) + k * ln(0.8), 6) AS geometric FROM v WHERE u BETWEEN 0.001 AND 0.999"""
)
def log_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, u, k = F.col("value"), F.col("value") / 600, F.floor(F.col("value") / 10).cast("double")
    d = maths.log_density
    each = {"normal": d("normal", x, mean=50.0, stdev=20.0), "gamma": d("gamma", x, shape=2.0, rate=0.05), "beta": d("beta", u, a=2.0, b=3.0), "poisson": d("poisson", k, rate=4.0), "binomial": F.when(k <= 9, d("binomial", k, n=9.0, p=0.3)), "geometric": d("geometric", k, p=0.2)}
    return table(spark, sf_dir, "events").where(u.between(0.001, 0.999)).select("event_id", *[F.round(e, 6).alias(n) for n, e in each.items()])


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) - 0.1 AS a, CAST(embedding[2] AS DOUBLE) + 0.2 AS b FROM embeddings)
    SELECT vec_id, round(-0.5 * (3 * a * a - 2 * 0.5 * a * b + 2 * b * b) / 5.75 - 0.5 * ln(5.75) - ln(2 * pi()), 5) AS log_p FROM v"""
)
def log_normal_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", F.round(maths.log_normal_density("embedding", [0.1, -0.2], [[2.0, 0.5], [0.5, 3.0]]), 5).alias("log_p"))


@query("SELECT event_id, a, b FROM (SELECT event_id, [event_id % 3, event_id % 5 + 10, event_id % 7 + 20] AS v FROM events), (VALUES (1, 2), (1, 3), (2, 3)) p(i, j), LATERAL (SELECT v[i] AS a, v[j] AS b)")
def pairs_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").withColumn("v", F.array(e % 3, e % 5 + 10, e % 7 + 20))
    return df.select("event_id", F.explode(maths.combinations("v", ("a", "b"))).alias("p")).select("event_id", "p.a", "p.b")


def _centre_sql(rounds: int) -> str:
    """Rounds of fuzzy means in SQL: each takes the one before it as one row."""
    out = "WITH c0 AS (SELECT 10.0 AS a, 60.0 AS b, 200.0 AS c)"
    for i in range(rounds):
        w = ", ".join(f"pow(greatest(abs(value - {k}), 1e-12), -2.0) AS w{k}" for k in "abc")
        u = ", ".join(f"pow(w{k} / (wa + wb + wc), 1.5) AS u{k}" for k in "abc")
        m = ", ".join(f"sum(u{k} * value) / sum(u{k}) AS {k}" for k in "abc")
        out += f", d{i} AS (SELECT value, {w} FROM events, c{i}), e{i} AS (SELECT value, {u} FROM d{i}), c{i + 1} AS (SELECT {m} FROM e{i})"
    return out + f" SELECT round(a, 5) AS low, round(b, 5) AS middle, round(c, 5) AS high FROM c{rounds}"


@query(_centre_sql(5))
def fuzzy_three_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, middle, high = maths.fuzzy_centres(table(spark, sf_dir, "events"), "value", [10.0, 60.0, 200.0])
    return spark.range(1).select(*[F.round(F.lit(x), 5).alias(n) for x, n in ((low, "low"), (middle, "middle"), (high, "high"))])


def erf_sql(z: str) -> str:
    """erf in SQL, by its series of positive terms."""
    return f"(2 / sqrt(pi()) * exp(-{z} * {z}) * list_sum([exp(2 * n * ln(2) + (2 * n + 1) * ln(greatest({z}, 1e-300)) + lgamma(n + 1) - lgamma(2 * n + 2)) FOR n IN range(150)]))"


@query(f"WITH v AS (SELECT event_id, (value - 50) / 20 AS z, abs(value - 50) / 20 / sqrt(2) AS a FROM events WHERE value < 200) SELECT event_id, round(CASE WHEN z > 0 THEN 0.5 + {erf_sql('a')} / 2 ELSE 0.5 - {erf_sql('a')} / 2 END, 8) AS p FROM v")
def normal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value < 200").select("event_id", F.round(maths.normal_cdf(F.col("value"), 50.0, 20.0), 8).alias("p"))
