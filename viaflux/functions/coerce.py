"""Coercion of text to logical types; what can't be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are read as booleans.
TRUE = ("true", "t", "1", "yes", "y", "si", "sí")
FALSE = ("false", "f", "0", "no", "n")
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
HHMM = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, _NUMERIC)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def text(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number(c: Column, kind: T.DataType) -> Column:
    """A double; NaN counts as null, and text has to look like a plain number."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if is_numeric(kind):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def integer(c: Column, kind: T.DataType) -> Column:
    """A long; text or numbers with a fraction are null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    d = number(c, kind)
    return F.when(d == F.floor(d), d.try_cast("long"))


def boolean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    t = F.lower(F.trim(c.cast("string")))
    if is_numeric(kind):
        t = F.when(c.cast("double") == 1, "1").when(c.cast("double") == 0, "0")
    return F.when(t.isin(*TRUE), F.lit(True)).when(t.isin(*FALSE), F.lit(False))


def hhmm(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(HHMM), t)


_DM = r"^\s*(\d{1,3})(?:\s*[°º]\s*|\s+)(\d{1,2}(?:[.,]\d+)?)\s*['’′]?\s*([NSEWOnsewo])\s*$"
_DMS = r"^\s*(\d{1,3})(?:\s*[°º]\s*|\s+)(\d{1,2})(?:\s*['’′]\s*|\s+)(\d{1,2}(?:[.,]\d+)?)\s*(?:\"|”|″|'')?\s*([NSEWOnsewo])\s*$"


def coordinate(c: Column, kind: T.DataType) -> Column:
    """Degrees from numbers, decimal commas, degrees and minutes, or degrees, minutes and seconds; white space may stand for marks."""
    if is_numeric(kind):
        return number(c, kind)
    t = F.trim(c.cast("string"))
    part = lambda p, k: F.regexp_extract(t, p, k)
    num = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    sign = lambda x: F.when(F.upper(x).isin("S", "W", "O"), -1.0).otherwise(1.0)
    dm = F.when(t.rlike(_DM), (num(part(_DM, 1)) + num(part(_DM, 2)) / 60) * sign(part(_DM, 3)))
    dms = F.when(t.rlike(_DMS), (num(part(_DMS, 1)) + num(part(_DMS, 2)) / 60 + num(part(_DMS, 3)) / 3600) * sign(part(_DMS, 4)))
    comma = F.replace(t, F.lit(","), F.lit("."))
    return F.coalesce(F.when(t.rlike(NUMBER), t.try_cast("double")), F.when(comma.rlike(NUMBER), comma.try_cast("double")), dm, dms)


def to(dtype: str, c: Column, kind: T.DataType) -> Column:
    """The column as a logical type other than datetime."""
    return {"int": integer, "float": number, "bool": boolean}.get(dtype, lambda x, _: text(x))(c, kind)
