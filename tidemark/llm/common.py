"""Helpers that the operators share: the shared scratch folder, written tables, text columns as bytes."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of whole texts that pass to a Python worker at once, at most (one longer text passes alone): Spark's own 10,000 rows or 64 MB are too much for long documents in several workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}
#: Bytes of a row group that a task holds as it writes. It and the pages are measured from the first row on: by Parquet's
#: own measure, after 100 rows, wide rows are one page a column, and codecs keep buffers of such a page's size for good.
ROW_GROUP = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by BATCH. It stays set, as plans run later than they are made."""
    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        now = conf.get(name, None)
        if now is None or not 0 < int(str(now).rstrip("bB")) <= most:
            conf.set(name, str(most))
    return df


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a new temporary one; a cluster must have it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: What the innermost running `passing` function has written: folders, each with its session and the table read from it.
_folders: ContextVar[list[tuple[str, SparkSession, DataFrame | None]] | None] = ContextVar("folders", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; a `passing` function that is running deletes it."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _folders.get()) is not None:
        own.append((path, spark, None))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if (own := _folders.get()) is not None:
        own[-1] = path, spark, out
    return out


def _deleted(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders, and lets the driver clean up the shuffles of plans that are gone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    _deleted(tables[0].sparkSession, [folder for df in tables for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}])


def passing(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """make, which returns a written table: whatever else it has written is deleted when it returns or fails."""

    @functools.wraps(make)
    def run(*args, **named) -> DataFrame:
        around, out, own = _folders.get(), None, []
        token = _folders.set(own)
        try:
            out = make(*args, **named)
        finally:
            _folders.reset(token)
            if gone := [x for x in own if x[2] is None or x[2] is not out]:
                _deleted(gone[0][1], [path for path, *_ in gone])
        if around is not None:
            around += [x for x in own if x[2] is out]
        return out

    return run


#: Ids that are broadcast to drop their rows, at most; beyond that they join.
DROPPED = 1 << 20


@passing
def _ids(found: Callable[[], DataFrame]) -> DataFrame:
    return written(found().select("doc_id"), "gone")


def without(docs: DataFrame, found: Callable[[], DataFrame]) -> DataFrame:
    """docs less the rows whose doc_id is in what found() returns (doc_id). Counted and small it is broadcast, so that no text moves.

    The tables that found() has written are deleted once its ids are known: no later stage finds the disk taken by them.
    """
    gone = _ids(found)
    return docs.join(F.broadcast(gone) if gone.count() <= DROPPED else gone, "doc_id", "left_anti").select(*docs.columns)


def fold(hex_of: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(hex_of), 16, "0"))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()
    return [x or b"" for x in batch.column(name).cast(kind).to_pylist()]


_held: dict = {}


def held(key, make: Callable[[], object]):
    """What a worker process keeps between its tasks: one thing at a time, so another key lets the last one go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """A task that keeps nothing frees what its worker holds for others."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def bucket3(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: what else a table carries can clash with nothing."""
    return df.select(*names)
