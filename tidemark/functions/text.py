"""Reading and writing field values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time patterns, asked in this order.
PATTERNS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss:SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm",
    "M/d/yy H:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
]


def parse_timestamp(s: Column) -> Column:
    """By the first pattern that fits; no fit is an error, null stays null."""
    read = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in PATTERNS])
    return F.when(s.isNull() | read.isNotNull(), read).otherwise(F.raise_error(F.concat(F.lit("no timestamp: "), s)).cast("timestamp"))


def format_timestamp(t: Column, fraction: bool = True) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS" if fraction else "yyyy-MM-dd HH:mm:ss")


def parse_bool(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), s)).cast("boolean"))


def parse_float(s: Column) -> Column:
    return F.nullif(s, F.lit("None")).cast("double")


def parse_int(s: Column) -> Column:
    return F.when(~s.isin("None", "NULL"), s).cast("long")


def _each(s: Column, swaps: list[tuple[str, str]]) -> Column:
    for a, b in swaps:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape(s: Column) -> Column:
    """Null is empty; backslash, newline and tab as escapes, a comma as a tab."""
    return F.coalesce(_each(s, [("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), (",", "\t")]), F.lit(""))


def unescape(s: Column) -> Column:
    """The inverse of escape; doubled backslashes are set aside first."""
    return _each(s, [("\t", ","), ("\\\\", "\x00"), ("\\n", "\n"), ("\\t", "\t"), ("\x00", "\\")])


def parse_bits(s: Column) -> Column:
    """'0101' as the places of its ones; other characters are an error."""
    ones = F.filter(F.transform(F.split(s, ""), lambda c, i: F.when(c == "1", i)), lambda i: i.isNotNull())
    return F.when(s.rlike("^[01]*$"), ones).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("no bits: "), s)).cast("array<int>"))


def format_bits(bits: Column, width: int) -> Column:
    """Each bit from the last to the first: the zeros up to it, and a one; the bits are evaluated once."""
    held = F.filter(F.array_sort(F.array_distinct(bits)), lambda b: b.between(0, width - 1))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, b: F.struct((b + 1).cast("int").alias("at"), F.concat(s["out"], F.repeat(F.lit("0"), (b - s["at"]).cast("int")), F.lit("1")).alias("out"))
    return F.aggregate(held, start, step, lambda s: F.concat(s["out"], F.repeat(F.lit("0"), F.lit(width) - s["at"])))


def draw_bits(bits: Column, width: int) -> Column:
    """Bits as '*' and '.'."""
    return F.translate(format_bits(bits, width), "10", "*.")


def parse_ints(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, " "), lambda x: x != ""), lambda x: x.cast("int"))


def format_ints(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), " ")


def is_json_of(s: Column, schema: str) -> Column:
    """Whether text is JSON of a DDL schema: it parses, and no value is of another kind than the schema says (missing and null fields are allowed); null for null."""
    read = F.from_json(s, f"{schema}, `_not json` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_not json"})
    return F.when(s.isNotNull(), F.coalesce(read["_not json"].isNull() & (F.trim(s) != ""), F.lit(False)))
