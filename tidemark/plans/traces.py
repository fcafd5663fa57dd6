"""Queries over what predicting states did, capped learning, and encoded records with noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sdr
from tidemark.functions.encoders import Distributed, Log
from tidemark.operators import aggregate, knn_learn, monitor, pooling, profile, records, windows
from tidemark.plans.catalog import EVENTS, RECORDS, query, table
from tidemark.plans.scoring import CODE, POOL, _records, _synapses
from tidemark.shared import shared_folder
from tidemark.spec import Aggregation, Interval, StreamSpec

#: A record's active columns are its value's bits; it predicts a cell of each of them for the next, but nothing for every fiftieth.
MONITORED = f"""WITH r AS (SELECT *, event_id % 50 = 0 AS begins, range(CAST(floor((value + 2.5) / 5.0) AS INT), CAST(floor((value + 2.5) / 5.0) AS INT) + 21) AS a FROM events),
    p AS (SELECT *, CASE WHEN begins THEN [] ELSE coalesce(lag([c * 4 + c % 4 FOR c IN a]) OVER ({RECORDS}), []) END AS p FROM r),
    q AS (SELECT *, [c FOR c IN p IF list_contains(a, c // 4)] AS pa, [c FOR c IN p IF NOT list_contains(a, c // 4)] AS pi FROM p),
    t AS (SELECT *, [c FOR c IN a IF NOT list_contains([d // 4 FOR d IN pa], c)] AS ua FROM q)"""
METRIC_SQL = "count(*) AS n, min(s) AS min, max(s) AS max, CAST(sum(s) AS BIGINT) AS sum, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS stdev"


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StreamSpec(EVENTS.keys, EVENTS.ts, EVENTS.order, reset="begins")
    begins = (F.col("event_id") % 50 == 0).cast("int").alias("begins")
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", begins, CODE.encode(F.col("value")).alias("active"))
    df = df.withColumn("predictive", F.transform("active", lambda c: (c * 4 + c % 4).cast("int")))
    return monitor.traces(monitor.predicted(df, spec, "predictive"), "active", "predicted", 4)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query(f"{MONITORED} SELECT event_id, CAST(len(pa) AS INT) AS predicted_active, array_to_string(list_sort([c // 4 FOR c IN pi]), ' ') AS predicted_inactive, array_to_string(ua, ' ') AS unpredicted FROM t")
def monitor_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predicted cells became active, and the columns that were predicted in vain or not at all."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    df = _monitored(spark, sf_dir)
    return df.select("event_id", F.size("predicted_active_cells").alias("predicted_active"), text("predicted_inactive_columns").alias("predicted_inactive"), text("unpredicted_active_columns").alias("unpredicted"))


@query(
    f"""{MONITORED}, s AS (SELECT unnest(['predicted_active_cells', 'predicted_inactive_cells', 'predicted_active_columns', 'predicted_inactive_columns', 'unpredicted_active_columns']) AS trace,
    unnest([len(pa), len(pi), len(pa), len(pi), len(ua)]) AS s FROM t WHERE NOT begins) SELECT trace, {METRIC_SQL} FROM s GROUP BY 1"""
)
def monitor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace's metric, records with a reset left out."""
    return _rounded(monitor.metrics(_monitored(spark, sf_dir), reset="begins"))


@query(
    f"""{MONITORED}, c AS (SELECT DISTINCT event_type, unnest(pa) AS cell FROM t),
    a AS (SELECT 'cells_per_column' AS trace, count(*) AS s FROM c GROUP BY event_type, cell // 4 UNION ALL SELECT 'sequences_per_cell', count(*) FROM c GROUP BY cell) SELECT trace, {METRIC_SQL} FROM a GROUP BY 1"""
)
def sequence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sequences: the cells that stand for each."""
    cells = monitor.sequence_cells(_monitored(spark, sf_dir), "event_type", 4)
    return _rounded(monitor.cells_per_column(cells, "event_type").unionByName(monitor.sequences_per_cell(cells)))


@query(f'{POOL} SELECT rec, CAST(col AS INT) AS "column", overlap FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY overlap DESC, col DESC) AS r FROM o) WHERE r <= 6')
def pooler_by_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 64 columns a share of 0.1 wins, which is as many as 3.2 of an area of 32 may be."""
    k = pooling.winners(64, density=0.1)
    if k != pooling.winners(64, per_area=3.2, area=32):
        raise ValueError("two ways of saying one density differ")
    return pooling.by_pattern(_records(spark, sf_dir), lambda patterns: pooling.inhibited(pooling.overlaps(patterns, _synapses(spark), 0.5), k))


@query(
    f"""WITH l AS (SELECT event_id, value, lag(value) OVER ({RECORDS}) AS p FROM events), g AS (SELECT event_id, CASE WHEN value > 0 THEN log10(value) ELSE -1 END AS a, CASE WHEN p > 0 THEN log10(p) WHEN p <= 0 THEN -1 END AS b FROM l)
    SELECT event_id, round(1 - least(1.0, abs(a - b) / 4), 6) AS close, round(abs(a - b), 6) AS apart FROM g WHERE b IS NOT NULL"""
)
def log_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close each value is to the one before it, for an encoder of logarithms."""
    code = Log(5, 0.1, 1000.0, n=50)
    df = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(EVENTS.records())).where("before is not null")
    close = lambda fractional: F.round(code.closeness(F.col("before"), F.col("value"), fractional), 6)
    return df.select("event_id", close(True).alias("close"), close(False).alias("apart"))


@query(
    """WITH RECURSIVE v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS x FROM embeddings),
    r AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, x DOUBLE[], used BIGINT)[]) AS kept FROM embeddings UNION ALL
    SELECT label, i, CASE WHEN near.d < 0.12 THEN [{'id': k.id, 'x': k.x, 'used': CASE WHEN k.id = near.id THEN vec_id ELSE k.used END} FOR k IN kept]
      ELSE list_append([k FOR k IN kept IF len(kept) < 5 OR k.used <> list_min([o.used FOR o IN kept])], {'id': vec_id, 'x': x, 'used': vec_id}) END
    FROM (SELECT v.label, v.i, v.vec_id, v.x, r.kept, list_min([{'d': list_distance(k.x, v.x), 'id': k.id} FOR k IN r.kept]) AS near FROM r JOIN v ON v.label = r.label AND v.i = r.i + 1)),
    f AS (SELECT label, unnest(kept) AS k FROM (SELECT *, max(i) OVER (PARTITION BY label) AS last FROM r) WHERE i = last) SELECT label, k.id AS row_id, k.used AS used FROM f"""
)
def knn_learnt_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier for each label, of five prototypes at most: the least recently used ones went."""
    own = F.slice("embedding", 1, 3).cast("array<double>").alias("vector")
    df = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("row_id"), own, F.col("label").alias("category"), F.lit(None).cast("long").alias("part"))
    return knn_learn.capped(df, 5, 0.12, keys=("label",)).select("label", "row_id", "used")


@query("SELECT label, vec_id AS row_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 4")
def knn_learnt_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a threshold the latest prototypes of each label stay."""
    df = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").alias("category"), F.lit(None).cast("long").alias("part"))
    return knn_learn.capped(df, 4, keys=("label",)).select("label", "row_id")


@query("SELECT event_id AS rec, CAST(21 AS INT) AS n, CAST(17 AS INT) AS common FROM events")
def sdr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each record's bits moved: as many bits as before, of which all but four stay."""
    df = _records(spark, sf_dir).withColumn("noisy", sdr.with_noise("bits", CODE.width, 0.2, F.concat(F.lit("noise "), F.col("rec").cast("string"))))
    return df.select("rec", F.size("noisy").alias("n"), sdr.overlap(F.col("bits"), F.col("noisy")).alias("common"))


@query(
    """WITH b AS (SELECT DISTINCT CAST(500 + floor(value / 5.0 + 0.5) AS INT) AS b FROM events)
    SELECT x.b AS one, y.b AS other, CAST(21 - (y.b - x.b) AS INT) AS common FROM b x JOIN b y ON y.b >= x.b AND y.b < x.b + 21"""
)
def distributed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two of the events' buckets that are nearer than 21: the common bits."""
    bits = Distributed(5.0).table()
    given = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "bucket int, bits array<int>")  # a thousand rows
    own = table(spark, sf_dir, "events").select((500 + F.floor(F.col("value") / 5.0 + 0.5)).cast("int").alias("bucket")).distinct().join(F.broadcast(given), "bucket")
    near = own.select(F.col("bucket").alias("one"), F.col("bits").alias("_one"), F.explode(F.sequence(F.col("bucket"), F.col("bucket") + 20)).alias("other"))
    return near.join(own.select(F.col("bucket").alias("other"), F.col("bits").alias("_other")), "other").select("one", "other", sdr.overlap(F.col("_one"), F.col("_other")).alias("common"))


@query(
    """WITH b AS (SELECT event_id, unnest(range(CAST(floor((value + 2.5) / 5.0) AS INT), CAST(floor((value + 2.5) / 5.0) AS INT) + 21)) AS b FROM events),
    k AS (SELECT event_id, b // 11 // 3 AS r, b % 11 // 3 AS c, count(*) AS n FROM b WHERE b // 11 < 9 AND b % 11 < 9 GROUP BY ALL),
    i AS (SELECT k.*, (SELECT count(*) FROM k o WHERE o.event_id = k.event_id AND abs(o.r - k.r) + abs(o.c - k.c) = 1) = 4 AS inner_box FROM k)
    SELECT event_id, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS "column", round(n / 9, 6) AS share, inner_box FROM i"""
)
def saturation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records' bits as levels of 11 x 11: how full each box of 3 x 3 is."""
    df = _records(spark, sf_dir).select(F.col("rec").alias("event_id"), F.explode(windows.saturation("bits", 11, 11, 3)).alias("s"))
    return df.select("event_id", F.col("s.row").cast("long").alias("row"), F.col("s.column").cast("long").alias("column"), F.round("s.share", 6).alias("share"), F.col("s.inner").alias("inner_box"))


@query("SELECT event_id, event_type, user_id FROM events")
def matching_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns whose names match a pattern from their start."""
    df = table(spark, sf_dir, "events")
    return records.project(df, records.matching(["event_", "user"], df.columns))


@query(
    """WITH a AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events)
    SELECT user_id, t0 + (epoch_us(ts) - t0) // 129600000000 * 129600000000 AS us, round(sum(value), 6) AS value, max(event_id) AS event_id FROM a GROUP BY ALL"""
)
def generated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a day and a half (18 times two hours), as a data set that is made once and read again."""
    two_hours = Interval.of(hours=2)
    period = Interval(seconds=two_hours.seconds * round(Interval.of(hours=36).over(two_hours)))
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-{spark.sparkContext.applicationId}"
    path = aggregate.generate_dataset(df, EVENTS, Aggregation(period, (("value", "sum"), ("event_id", "max"))), folder, "events.parquet")
    return spark.read.parquet(path).select("user_id", F.unix_micros("ts").alias("us"), F.round("value", 6).alias("value"), "event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def cached_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are computed once and read from then on."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return profile.cached(counts, f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-{spark.sparkContext.applicationId}/counts")
