"""Counts and extremes of a Parquet table from its footers, without reading data."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..session import session

#: Types whose nulls footers count as the profile does (NaN and infinities, which it takes for nulls, are in no footer).
COUNTED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Types whose extremes are exact there: those of long strings may be cut.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _pushing(spark: SparkSession) -> SparkSession:
    """A session like this one that answers aggregates from footers; the caller's settings stay as they are."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    kept = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in kept if x.strip().lower() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def pushed(df: DataFrame) -> bool:
    """Whether an aggregate reads footers only."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [" in plan and "PushedAggregation: []" not in plan


def footer_figures(path: str) -> dict[str, dict]:
    """rows (under the name ""), and by column its count (n), least (low) and greatest (high) value, for columns whose footers tell.

    A column of which some row group has no statistics is left out: columns are
    asked for together, and in halves where that fails.  Nothing is collected
    but one row of figures; each task reads footers.
    """
    df = _pushing(session()).read.parquet(path)
    fields = [f for f in df.schema.fields if isinstance(f.dataType, COUNTED)]

    def ask(part: list) -> dict[str, dict]:
        made = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(part):
            made.append(F.count(quoted(f.name)).alias(f"n{i}"))
            if isinstance(f.dataType, ORDERED):
                made += [F.min(quoted(f.name)).alias(f"low{i}"), F.max(quoted(f.name)).alias(f"high{i}")]
        found = df.agg(*made)
        if not pushed(found):
            return ask(part[: len(part) // 2]) | ask(part[len(part) // 2 :]) if len(part) > 1 else {}
        try:
            row = found.first().asDict()
        except (PySparkException, Py4JJavaError):
            return ask(part[: len(part) // 2]) | ask(part[len(part) // 2 :]) if len(part) > 1 else {}
        return {"": {"rows": row["rows"]}} | {f.name: {k: row.get(f"{k}{i}") for k in ("n", "low", "high")} for i, f in enumerate(part)}

    return ask(fields) if fields else {}
