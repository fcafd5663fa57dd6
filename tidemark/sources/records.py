"""Record files: CSV with three header rows (names, types, special flags R, S, T, C, L)."""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.aggregate import aggregate
from tidemark.operators.records import filter_records, project, row_range
from tidemark.shared import shared_folder  # noqa: F401  callers take it from here, too
from tidemark.sources import lines
from tidemark.spec import Aggregation, Interval, StreamSpec

#: Reading and writing by type.
READ = {"string": text.unescape, "int": text.parse_int, "float": text.parse_float, "bool": text.parse_bool, "datetime": text.parse_timestamp, "list": text.parse_ints, "sdr": text.parse_bits}
SPECIALS = {"R": {"int"}, "S": {"string", "int"}, "T": {"datetime"}, "C": {"int", "list"}, "L": {"int"}, "": set(READ)}


@dataclass(frozen=True, slots=True)
class Field:
    name: str
    type: str
    special: str = ""

    def __post_init__(self):
        if self.type not in READ or self.special not in SPECIALS or self.type not in SPECIALS[self.special]:
            raise ValueError(f"no such field: {self}")


def _line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of a folder of parts by their names (value), in order (rec_idx). Scans take parts in any order, so each split of a file has its rank: a row a split, however many lines it has."""
    own = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    splits = spark.read.text(path).select(*own).distinct()
    ranks = splits.withColumn("_rank", F.row_number().over(Window.orderBy("_path", "_start")).cast("long"))
    lines = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("value"), F.monotonically_increasing_id().alias("_id"), *own)
    return lines.join(F.broadcast(ranks), ["_path", "_start"]).select("value", (F.shiftleft(F.col("_rank"), 33) + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("rec_idx"))


def _header(spark: SparkSession, path: str) -> tuple[list[Field], int]:
    """The fields of a file, and the place of the last of its three header lines: the three least places, found by each task for itself."""
    first = _lines(spark, path).orderBy("rec_idx").limit(3).collect()
    if len(first) < 3:
        raise ValueError(f"no three header lines: {path}")
    return _fields([r["value"] for r in first]), first[-1]["rec_idx"]


def read_fields(spark: SparkSession, path: str) -> list[Field]:
    """The fields that a file's three header lines name."""
    return _header(spark, path)[0]


def _typed(rows: DataFrame, fields: list[Field], missing: tuple[str, ...]) -> DataFrame:
    """value, rec_idx -> the typed fields and rec_idx."""
    parsed = F.from_csv("value", ", ".join(f"_{i} string" for i in range(len(fields))), {"mode": "PERMISSIVE", "escape": '"'})
    rows = rows.select("rec_idx", parsed.alias("r"))
    out = []
    for i, f in enumerate(fields):
        raw = F.col("r")[f"_{i}"]
        out.append(READ[f.type](F.when(~raw.isin(*missing), raw)).alias(f.name, metadata={"special": f.special, "type": f.type}))
    return rows.select(*out, "rec_idx")


def read_records(spark: SparkSession, path: str, missing: tuple[str, ...] = ("",)) -> DataFrame:
    """The typed records, and rec_idx in the file's order. Special flags are in the columns' metadata. The header goes by its place, so that a record may look like it; an empty line is a record with all values missing."""
    fields, last = _header(spark, path)
    return _typed(_lines(spark, path).where(F.col("rec_idx") > last), fields, missing)


def _fields(head: list[str]) -> list[Field]:
    names, types, specials = ([x.strip() for x in next(csv.reader([line]), [""])] for line in head)
    specials += [""] * (len(names) - len(specials))
    return [Field(*f) for f in zip(names, types, specials, strict=True)]


def read_growing(spark: SparkSession, path: str, stream: bool = False, missing: tuple[str, ...] = ("",)) -> DataFrame:
    """The typed records of one file that may grow; rec_idx is a record's byte offset, which is also what a stream resumes at. Its header is read from its first block, once."""
    spark.dataSource.register(lines.RecordLines)
    rows = (spark.readStream if stream else spark.read).format("record_lines").load(path)
    return _typed(rows, _fields(lines.header(path)[0]), missing)


def append_records(df: DataFrame, fields: list[Field], order: list[str], path: str) -> None:
    """Records behind those of a folder that write_records made, in order; its header says what the fields have to be, and stays the only one. Tasks write parts beside the folder's own, which then get the names that come next: no record moves twice, and none passes through the driver."""
    spark = df.sparkSession
    if read_fields(spark, path) != fields:
        raise ValueError(f"the folder has other fields: {path}")
    fresh = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"  # readers pass over such names
    df.orderBy(*order).select(F.concat_ws(",", *[_quoted(_written(f)) for f in fields]).alias("value")).write.text(fresh)
    jvm = spark.sparkContext._jvm
    at = lambda *names: jvm.org.apache.hadoop.fs.Path(*names)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = lambda folder: sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-"))
    number = max(int(name[5:10]) for name, _ in parts(path)) + 1
    for name, length in parts(fresh):
        if length:
            fs.rename(at(fresh, name), at(path, f"part-{number:05d}{name[10:]}"))
            number += 1
    fs.delete(at(fresh), True)


def spec_of(df: DataFrame, keys: tuple[str, ...] = ()) -> StreamSpec:
    """The roles that the columns' metadata names; a file without a key is one stream."""
    special = {f.metadata.get("special"): f.name for f in df.schema.fields if f.metadata.get("special")}
    return StreamSpec(keys or (), special.get("T", "rec_idx"), ("rec_idx",), special.get("R"), special.get("S"), special.get("C"), special.get("L"))


def _written(f: Field) -> Column:
    c = F.col(f.name)
    if f.type == "string":
        return text.escape(c)
    if f.type == "datetime":
        return F.coalesce(text.format_timestamp(c), F.lit(""))
    if f.type == "list":
        return F.coalesce(text.format_ints(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_records(df: DataFrame, fields: list[Field], order: list[str], path: str) -> None:
    """One folder of text parts in order, the header at the start of the first."""
    head = [_line([getattr(f, k) for f in fields]) for k in ("name", "type", "special")]
    rows = df.orderBy(*order).select(F.concat_ws(",", *[_quoted(_written(f)) for f in fields]).alias("value"))
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    spark = df.sparkSession
    header = spark.createDataFrame([(line, -1, i - 3) for i, line in enumerate(head)], "value string, _part int, _at long")
    header.union(rows).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.text(path)


def out_of_order(df: DataFrame, spec: StreamSpec) -> DataFrame:
    """Records whose time is before their predecessor's in the same sequence, by the order columns."""
    by = [*spec.keys, *([spec.sequence] if spec.sequence else [])]
    before = F.lag(spec.ts).over(Window.partitionBy(*by).orderBy(*spec.order))
    return df.withColumn("_before", before).where(F.col(spec.ts) < F.col("_before")).drop("_before")


def read_stream(spark: SparkSession, definition: dict) -> DataFrame:
    """A stream definition: {streams: [{source, columns, first_record, last_record}], filter, aggregation: {fields, hours: 1, ...}}. One source; filters are honoured."""
    (stream,) = definition["streams"]
    df = read_records(spark, stream["source"])
    spec = spec_of(df)
    df = row_range(df, spec, stream.get("first_record") or 0, stream.get("last_record"))
    if definition.get("filter"):
        df = filter_records(df, definition["filter"])
    if agg := definition.get("aggregation"):
        units = {k: v for k, v in agg.items() if k != "fields" and v}
        df = aggregate(df, spec, Aggregation(Interval.of(**units), tuple(map(tuple, agg.get("fields", ())))))
    return project(df, stream.get("columns") or ["*"])
