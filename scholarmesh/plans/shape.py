"""Common output form of registered queries: plain columns that compare equal across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, dates as text, doubles rounded, arrays of text joined by '|'."""
    out = []
    for field in df.schema:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(field.name))
    return df.select(*out)
