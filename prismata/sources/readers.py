"""Turning a path, a Spark or a pandas-like frame into a typed DataFrame."""

from __future__ import annotations

import math
import os
import random
from collections import OrderedDict
from dataclasses import dataclass, field
from pathlib import PurePath
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BOOLEAN_WORDS, DATE_FORMATS, DATE_SHARE, FLOAT_PATTERN, INTEGER_PATTERN, decide_type, parse, parse_date, quoted, without_markers
from ..session import PrismataError, session
from .multiline import csv_records

EXTENSIONS = (".csv", ".parquet")
INFER_ROWS = 5000


@dataclass
class Dataset:
    df: DataFrame
    name: str
    path: str | None = None
    misfits: dict[str, Column] = field(default_factory=dict)  # by column: whether a cell did not fit the inferred type
    sampled: bool = False
    whole: DataFrame | None = None  # what a sample was drawn from
    weight: float = 1.0  # rows of the whole that a row of the sample stands for

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__misfit_")]

    @property
    def data(self) -> DataFrame:
        """All rows, without the helper columns; those of a sample's source."""
        rows = self.df if self.whole is None else self.whole
        return rows.select(*[quoted(c) for c in self.columns])

    def sample(self, rows: int, seed: int = 17, files: int | None = None) -> Dataset:
        """A random part of ``rows`` rows, which knows all of them; itself if it has no more.

        Each row draws a number, and those with the least ones are in: all parts
        of a table have the same chance, its end too.  ``files`` reads only so
        many of the table's files, spread evenly over their order from a random
        start; then ``weight`` makes totals of the sample unbiased ones of the whole.
        """
        if rows < 1 or files is not None and files < 1:
            raise PrismataError("sample_size and sample_files must be positive")
        n = row_count(self.df, self.path)
        if n <= rows:
            return self
        df, weight = self.df, 1.0
        if files:
            every = sorted(df.inputFiles())
            chosen = spread(every, files, seed)
            if len(chosen) < len(every):
                # file paths of the two interfaces differ in the slashes of a local one
                df = df.where(F.col("_metadata.file_path").isin([x.replace("file:///", "file:/") for x in chosen]))
                weight, n = len(every) / len(chosen), df.count()
        if n <= rows:
            return Dataset(df, self.name, self.path, self.misfits, True, self.df, weight)
        name = "__draw"
        while name in df.columns:
            name += "_"
        drawn = df.withColumn(name, F.rand(seed))
        enough = (rows + 6 * math.sqrt(rows) + 6) / n  # more than ``rows`` draw less than this
        cut = drawn.select(name).where(F.col(name) < enough).orderBy(name).limit(rows).agg(F.max(name)).first()[0]
        kept = drawn.where(F.col(name) <= (cut if cut is not None else enough)).drop(name)
        return Dataset(kept, self.name, self.path, self.misfits, True, self.df, weight * n / rows)


def spread(files: list[str], many: int, seed: int) -> list[str]:
    """So many of the files, evenly over their order, from a random start."""
    many = min(many, len(files))
    start = random.Random(seed).random()
    return [files[min(len(files) - 1, int((k + start) * len(files) / many))] for k in range(many)]


def _hadoop(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def check_path(path: str, allowed_dir: str | None = None) -> str:
    """The path, if it exists, has a known extension, is not empty, not binary (CSV) and lies within ``allowed_dir``."""
    if "\0" in path:
        raise PrismataError("path holds a null byte")
    if allowed_dir is not None and "://" not in path:
        inside, top = os.path.realpath(path), os.path.realpath(allowed_dir)
        if os.path.commonpath([inside, top]) != top:
            raise PrismataError(f"path is outside the allowed folder: {path}")
    fs, at = _hadoop(session(), path)
    if not fs.exists(at):
        raise PrismataError(f"file not found: {path}")
    extension = PurePath(path).suffix.lower()
    if extension not in EXTENSIONS:
        raise PrismataError(f"unsupported file type {extension or '(none)'}: use {' or '.join(EXTENSIONS)}")
    if fs.getContentSummary(at).getLength() == 0:
        raise PrismataError(f"file is empty: {path}")
    if extension == ".csv" and fs.getFileStatus(at).isFile():
        stream = fs.open(at)
        head = bytes(b & 0xFF for b in stream.readNBytes(512))
        stream.close()
        if b"\0" in head:
            raise PrismataError(f"file looks binary: {path}")
    return path


def file_bytes(path: str) -> int:
    fs, at = _hadoop(session(), path)
    return fs.getContentSummary(at).getLength()


_COUNTS: OrderedDict[tuple, int] = OrderedDict()
_COUNTS_LOCK = Lock()
#: Row counts that are remembered, by path, size and time of change.
COUNTS_KEPT = 100


def row_count(df: DataFrame, path: str | None) -> int:
    """Rows of the frame; those of a file are remembered while it doesn't change."""
    if path is None:
        return df.count()
    fs, at = _hadoop(session(), path)
    key = (path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    with _COUNTS_LOCK:
        if key in _COUNTS:
            _COUNTS.move_to_end(key)
            return _COUNTS[key]
    n = df.count()
    with _COUNTS_LOCK:
        _COUNTS[key] = n
        while len(_COUNTS) > COUNTS_KEPT:
            _COUNTS.popitem(last=False)
    return n


def infer_types(raw: DataFrame, rows: int = INFER_ROWS) -> dict[str, str]:
    """Type of each string column (null markers already null), from its first rows: one conditional aggregate."""
    counts = []
    for i, c in enumerate(raw.columns):
        x = quoted(c)
        boolean = x.isin(BOOLEAN_WORDS)
        integer = x.rlike(INTEGER_PATTERN)
        real = x.rlike(FLOAT_PATTERN) & ~F.isnan(x.try_cast("double")) & (F.abs(x.try_cast("double")) != float("inf"))
        counts += [
            F.count_if(boolean).alias(f"b{i}"),
            F.count_if(integer).alias(f"i{i}"),
            F.count_if(integer & x.isin("0", "1")).alias(f"z{i}"),
            F.count_if(~boolean & ~integer & real).alias(f"f{i}"),
            F.count_if(~boolean & ~integer & ~real).alias(f"s{i}"),
        ]
    got = raw.limit(rows).agg(*counts).first()
    return {c: decide_type(*(got[f"{k}{i}"] for k in "bizfs")) for i, c in enumerate(raw.columns)}


def infer_date_formats(raw: DataFrame, names: list[str], rows: int = INFER_ROWS) -> dict[str, str]:
    """The date pattern of those of the string columns that have one: each of the first rows votes for all that fit it.

    The one with the most votes is a column's if it fits DATE_SHARE of its
    cells; of equal ones, the first in DATE_FORMATS.
    """
    if not names:
        return {}
    counts = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]
    counts += [F.count(parse_date(quoted(c), p)).alias(f"v{i}_{k}") for i, c in enumerate(names) for k, p in enumerate(DATE_FORMATS)]
    got = raw.limit(rows).agg(*counts).first()
    out = {}
    for i, c in enumerate(names):
        votes = [got[f"v{i}_{k}"] for k in range(len(DATE_FORMATS))]
        best = votes.index(max(votes))
        if votes[best] and votes[best] >= DATE_SHARE * got[f"n{i}"]:
            out[c] = list(DATE_FORMATS)[best]
    return out


def spans_lines(path: str) -> bool:
    """Whether a quoted field of the CSV file reaches over a line's end, or a line holds blanks only: one scan, split over the tasks.

    The line in which such a field begins has an odd number of quotes.
    """
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1
    return not session().read.text(path).where(odd | line.rlike(r"^\s+$")).isEmpty()


def read_csv(path: str, sep: str = ",", null_string: str | None = None, header: bool = True, infer_rows: int = INFER_ROWS, infer_dates: bool = False) -> Dataset:
    """A CSV file with types by majority of its first rows; cells that don't fit become null and are counted.

    Many tasks read a file, also one whose fields span lines.  ``infer_dates`` looks
    for dates and times in text columns, of one format a column; a cell of
    another format doesn't fit.
    """
    spark = session()
    spans = spans_lines(path)
    raw = spark.read.csv(path, header=header, sep=sep, quote='"', escape='"', multiLine=spans, mode="PERMISSIVE", encoding="UTF-8", inferSchema=False, enforceSchema=True, emptyValue="")
    names = [c.lstrip("﻿").strip(' \t"') for c in raw.columns] if header else [f"col_{i}" for i in range(len(raw.columns))]
    raw = raw.toDF(*[f"__raw_{i}" for i in range(len(names))])
    first = None
    if spans:  # that reader is one task a file
        records, top, end = csv_records(path, sep, header, infer_rows)
        options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "multiLine": "true", "lineSep": end}
        fields = F.from_csv("record", ", ".join(f"{c} string" for c in raw.columns), options)
        cells = lambda rows: rows.select(fields.alias("cells")).select("cells.*")
        raw, first = cells(records), cells(top)
    marked = lambda rows: rows.select(*[without_markers(F.col(c), null_string).alias(c) for c in rows.columns])
    raw, first = marked(raw), marked(first or raw)
    kinds = infer_types(first, infer_rows)
    dates = infer_date_formats(first, [c for c in raw.columns if kinds[c] == "str"], infer_rows) if infer_dates else {}
    typed, misfits = [], {}
    for name, c in zip(names, raw.columns):
        value = parse_date(F.col(c), dates[c]) if c in dates else parse(F.col(c), kinds[c]) if kinds[c] != "unknown" else F.col(c)
        typed.append(value.alias(name))
        if kinds[c] in ("int", "float", "bool") or c in dates:
            typed.append((F.col(c).isNotNull() & value.isNull()).alias(f"__misfit_{name}"))
            misfits[name] = quoted(f"__misfit_{name}")
    return Dataset(raw.select(*typed), PurePath(path).name, path, misfits)


def resolve(data, sample_size: int | None = None, allowed_dir: str | None = None, sample_files: int | None = None, **csv) -> Dataset:
    """A Dataset from a path, a Spark DataFrame, or anything with ``to_pandas`` or pandas' shape.

    All rows, unless ``sample_size`` asks for a sample of as many, drawn from
    all rows or from ``sample_files`` of the files.
    """
    if isinstance(data, Dataset):
        return data
    if isinstance(data, DataFrame):
        found = Dataset(data, "<DataFrame>")
    elif isinstance(data, (str, os.PathLike)):
        path = check_path(os.fspath(data), allowed_dir)
        try:
            found = read_csv(path, **csv) if path.lower().endswith(".csv") else Dataset(session().read.parquet(path), PurePath(path).name, path)
        except (PySparkException, Py4JJavaError) as e:
            raise PrismataError(f"can't read {path}: {str(e).splitlines()[0][:200]}") from e
    elif hasattr(data, "to_pandas") or type(data).__module__.startswith("pandas"):
        found = Dataset(session().createDataFrame(data.to_pandas() if hasattr(data, "to_pandas") else data), "<DataFrame>")
    else:
        raise PrismataError(f"unsupported input type: {type(data).__name__}")
    if not found.columns:
        raise PrismataError("no columns")
    return found if sample_size is None else found.sample(sample_size, files=sample_files)


def count_lines(path: str) -> int:
    """Lines of a text file, the last one included whether or not it ends in a newline."""
    return session().read.text(path).count()


def info(path: str) -> dict:
    check_path(path)
    rows = count_lines(path) - 1 if path.lower().endswith(".csv") else session().read.parquet(path).count()
    return {"file": PurePath(path).name, "size_mb": file_bytes(path) / 1e6, "rows": rows}
