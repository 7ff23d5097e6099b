"""Rows in the dialect's text form, as a sink for clients that read text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_of(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(column, "t").when(~column, "f")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.regexp_replace(column.cast("string"), r"\.0$", "")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(column)))
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.TimestampType):
        return F.regexp_replace(F.date_format(column, "yyyy-MM-dd HH:mm:ssxxx"), ":00$", "")
    if isinstance(kind, T.DayTimeIntervalType):
        micros = F.unix_micros(F.timestamp_micros(F.lit(0)) + column)
        sign, size = F.when(micros < 0, "-").otherwise(""), F.abs(micros)
        seconds = F.floor(size / 1_000_000)
        rest = size % 1_000_000
        clock = F.format_string("%s%02d:%02d:%02d", sign, F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
        return F.concat(clock, F.when(rest > 0, F.format_string(".%06d", rest)).otherwise(""))
    return column.cast("string")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, nulls as null; computed where the rows are."""
    return df.select(*[text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
