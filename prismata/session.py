"""Session defaults and the library's error."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FOLDERS: dict[str, str] = {}


class PrismataError(Exception):
    """Any error that a user can mend: a bad path, an unsupported input, an impossible request."""


def session(**conf: str) -> SparkSession:
    """The running session, or a new one with UTC, Arrow and adaptive execution."""
    found = SparkSession.getActiveSession()
    if found:
        return found
    build = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        build = build.config(k, v)
    return build.getOrCreate()


_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}


def small_frame(rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of a few rows that the driver has made; it comes by Arrow, so that no Python worker starts for it."""
    schema = T.StructType.fromDDL(ddl)
    types = [pa.list_(_ARROW[type(f.dataType.elementType)]) if isinstance(f.dataType, T.ArrayType) else _ARROW[type(f.dataType)] for f in schema]
    columns = zip(*rows) if rows else ([] for _ in types)
    return session().createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.names), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local one (as in tests) gets a temporary
    folder of its own; on a cluster that would be a folder of one machine, so
    it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise PrismataError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        app = spark.sparkContext.applicationId
        found = _FOLDERS[app] if app in _FOLDERS else _FOLDERS.setdefault(app, f"file://{tempfile.mkdtemp(prefix='prismata-')}")
    return found.rstrip("/")
