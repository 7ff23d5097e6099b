"""Rows in the dialect's binary form, as a sink for clients that read binary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The form's dates and times count from 2000-01-01.
EPOCH_DAYS, EPOCH_MICROS = 10_957, 946_684_800_000_000


def as_binary(df: DataFrame) -> DataFrame:
    """Every column as bytes, nulls as null, by a map over the rows.

    Numbers are big-endian, a date is its days and a timestamp its microseconds since 2000-01-01 (both in UTC), text,
    json and bytes are themselves, jsonb has no type of its own here. Intervals keep their text form, as in the
    dialect.
    """
    from larkspur.sources.text import text_of

    fields, cols = df.schema.fields, []
    for f in fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.DateType):
            c = (F.unix_date(c) - EPOCH_DAYS).cast("int")
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c) - EPOCH_MICROS
        elif isinstance(kind, T.TimestampNTZType):
            c = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), c)
        elif isinstance(kind, T.DayTimeIntervalType | T.StringType):
            c = text_of(c, kind).cast("binary")
        cols.append(c.alias(f.name))
    names = [f.name for f in fields]
    out = T.StructType([T.StructField(n, T.BinaryType()) for n in names])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        forms = {pa.bool_(): "u1", pa.int16(): ">i2", pa.int32(): ">i4", pa.int64(): ">i8", pa.float32(): ">f4", pa.float64(): ">f8"}

        def column(a):
            if a.type not in forms:
                return a.cast(pa.binary())
            valid = a.is_valid().to_numpy(zero_copy_only=False)
            full = a.fill_null(False if pa.types.is_boolean(a.type) else 0).to_numpy(zero_copy_only=False).astype(forms[a.type])
            offs = np.arange(len(a) + 1, dtype=np.int32) * full.itemsize
            return pa.BinaryArray.from_buffers(pa.binary(), len(a), [pa.py_buffer(np.packbits(valid, bitorder="little")), pa.py_buffer(offs), pa.py_buffer(full.tobytes())])

        for b in batches:
            yield pa.RecordBatch.from_arrays([column(a) for a in b.columns], names=names)

    return df.select(*cols).mapInArrow(run, out)
