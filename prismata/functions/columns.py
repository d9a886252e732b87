"""Types, null markers, lenient parsing and predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers that count as null, whatever their case, and the spellings of booleans.
NULL_MARKERS = ["", "?", "na", "nan", "n/a", "null", "none", "#n/a"]
BOOLEAN_WORDS = ["true", "True", "TRUE", "false", "False", "FALSE", "yes", "Yes", "YES", "no", "No", "NO", "y", "Y", "n", "N"]
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y"], ["0", "false", "no", "n"]

INTEGER_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

#: Shapes of dates and times that a CSV column may have throughout: the pattern of the parser, and the shape that a cell must have.
#: Where days and months can't be told apart, the day comes first.
_TIME = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
DATE_FORMATS = {
    "yyyy-MM-dd": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "yyyy/MM/dd": "^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    "dd/MM/yyyy": "^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "MM/dd/yyyy": "^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "dd.MM.yyyy": r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$",
    "dd-MM-yyyy": "^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "yyyy-MM-dd HH:mm:ss": f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_TIME}$",
    "yyyy-MM-dd'T'HH:mm:ss": f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}$",
    "yyyy/MM/dd HH:mm:ss": f"^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {_TIME}$",
    "dd/MM/yyyy HH:mm:ss": f"^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} {_TIME}$",
    "MM/dd/yyyy HH:mm:ss": f"^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} {_TIME}$",
}
#: Share of a column's cells that one of these must fit.
DATE_SHARE = 0.8

NUMERIC = ("int", "float")


def type_name(kind: T.DataType) -> str:
    """int, float, bool, str, datetime or unknown."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "unknown"


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_markers(raw: Column, extra: str | None = None) -> Column:
    """Null for a null marker (any case, not trimmed) or the extra null string."""
    found = F.lower(raw).isin(NULL_MARKERS)
    if extra is not None:
        found = found | (raw == extra)
    return F.when(~found, raw)


def as_number(c: Column, kind: str) -> Column:
    """The numeric value as double; null for nulls, NaN and infinities (they would poison every aggregate)."""
    x = c.cast("int").cast("double") if kind == "bool" else c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) if kind == "float" else x


def seconds(c: Column, kind: T.DataType) -> Column:
    """Epoch seconds of a date or timestamp."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def present(c: Column, kind: str) -> Column:
    """The value, or null where it counts as null."""
    return F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c) if kind == "float" else c


def parse(raw: Column, kind: str) -> Column:
    """A marker-free string as the inferred type; null where it doesn't fit."""
    if kind == "int":
        return F.when(raw.rlike(INTEGER_PATTERN), raw.try_cast("long"))
    if kind == "float":
        x = raw.try_cast("double")
        return F.when(raw.rlike(FLOAT_PATTERN) & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if kind == "bool":
        low = F.lower(raw)
        return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))
    return raw


def parse_date(raw: Column, pattern: str) -> Column:
    """A string as date, or timestamp if the pattern has a time; null where it doesn't fit or names no day that exists."""
    found = F.try_to_timestamp(F.when(raw.rlike(DATE_FORMATS[pattern]), raw), F.lit(pattern))
    return found if "HH" in pattern else found.cast("date")


def decide_type(b: int, i: int, i01: int, f: int, s: int) -> str:
    """The type of a column with so many boolean words, integers (of them 0 or 1), other floats and other strings."""
    n = b + i + f + s
    if n == 0:
        return "unknown"
    if s:
        if b and b >= 0.8 * n:
            return "bool"
        if i + f >= 0.98 * n and s <= 2:
            return "float" if f else "int"
        return "str"
    if b:
        if i == i01 and not f:
            return "bool"
        return "float" if f else "int"
    return "float" if f else "int" if i else "str"


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def outlier(p, strict: bool = True) -> Column | bool:
    """Whether a column's maximum is far above its mean.

    ``p`` gives the fields by name: profile rows on the driver (plain values) or
    Columns.  ``strict`` adds the exemptions for small means and enumerations.
    """
    both = (lambda *x: all(x)) if not isinstance(p("mean"), Column) else every
    isint = p("type_str") == "int"
    isnum = isint | (p("type_str") == "float") if isinstance(isint, Column) else p("type_str") in NUMERIC
    name = p("name")
    named = (~F.lower(name).contains("ratio") & ~F.lower(name).contains("pct")) if isinstance(name, Column) else "ratio" not in name.lower() and "pct" not in name.lower()
    base = both(isnum, p("mean") > 0, p("unique_approx") > 5, p("val_max") > 10, p("val_max") > p("mean") * 10, named)
    if not strict:
        return base
    flip = (lambda x: ~x) if isinstance(isint, Column) else (lambda x: not x)
    return both(
        base,
        p("mean") >= 2,
        flip(both(isint, p("unique_approx") < 15, p("val_min") >= 0)),
        flip(both(isint, p("val_min") == 0, p("val_max") <= p("unique_approx") + 5)),
    )
