"""The profile of a dataset: statistics of each column, correlations, totals."""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..functions.columns import NUMERIC
from ..plans.passes import distinct_pass, exact_extremes, fields_of, first_pass, second_pass, shape
from ..session import small_frame
from ..sources.footers import footer_figures
from ..sources.readers import Dataset, resolve

#: Correlations are left out beyond so many numeric columns unless asked for, and reported from this size on.
WIDE, REPORT = 50, 0.5


@dataclass
class ColumnProfile:
    name: str
    type_str: str
    total_count: int = 0
    null_count: int = 0
    non_null_count: int = 0
    unique_approx: int = 0
    null_pct: float = 0.0
    unique_pct: float = 0.0
    type_mismatch_count: int = 0
    type_mismatch_pct: float = 0.0
    mean: float = 0.0
    stddev: float = 0.0
    variance: float = 0.0
    skewness: float = 0.0
    kurtosis: float = 0.0
    val_min: float = 0.0
    val_max: float = 0.0
    range: float = 0.0
    min_str_len: int = 0
    max_str_len: int = 0
    mean_str_len: float = 0.0
    has_high_nulls: bool = False
    is_constant: bool = False
    is_high_cardinality: bool = False
    histogram_bins: list[int] = field(default_factory=list)
    top_values: list[str] = field(default_factory=list)
    unique_exact: int = -1
    exact_unique_valid: bool = False
    zero_count: int = 0


COLUMN_SCHEMA = (
    "name string, type_str string, total_count long, null_count long, non_null_count long, unique_approx long, null_pct double, unique_pct double, type_mismatch_count long, type_mismatch_pct double, "
    "mean double, stddev double, variance double, skewness double, kurtosis double, val_min double, val_max double, range double, min_str_len long, max_str_len long, mean_str_len double, "
    "has_high_nulls boolean, is_constant boolean, is_high_cardinality boolean, histogram_bins array<long>, top_values array<string>, unique_exact long, exact_unique_valid boolean, zero_count long"
)


@dataclass
class Correlation:
    col_a: str
    col_b: str
    r: float

    @property
    def direction(self) -> str:
        return "positive" if self.r > 0 else "negative"

    @property
    def strength(self) -> str:
        x = abs(self.r)
        return "very_strong" if x >= 0.9 else "strong" if x >= 0.7 else "moderate" if x >= 0.5 else "weak"


@dataclass
class DatasetProfile:
    file_path: str
    file_name: str
    num_rows: int
    num_cols: int
    num_numeric: int
    num_string: int
    overall_null_pct: float
    total_null_cells: int
    total_cells: int
    scan_time_ms: float
    is_sampled: bool
    columns: list[ColumnProfile]
    correlations: list[Correlation]
    correlation_skipped: bool = False

    def column(self, name: str) -> ColumnProfile | None:
        return next((c for c in self.columns if c.name == name), None)

    def to_dict(self) -> dict:
        cols = []
        for c in self.columns:
            keep = ["name", "type_str", "null_pct", "unique_approx"]
            keep += ["mean", "stddev", "val_min", "val_max", "skewness"] if c.type_str in NUMERIC else ["mean_str_len"]
            cols.append({k: getattr(c, k) for k in keep})
        head = ("file_name", "num_rows", "num_cols", "overall_null_pct", "scan_time_ms", "is_sampled")
        return {k: getattr(self, k) for k in head} | {"columns": cols, "correlations": [{"col_a": c.col_a, "col_b": c.col_b, "r": c.r} for c in self.correlations]}

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent)

    def columns_frame(self) -> DataFrame:
        """One row for each column, all fields."""
        return small_frame([tuple(asdict(c).values()) for c in self.columns], COLUMN_SCHEMA)

    def correlations_frame(self) -> DataFrame:
        rows = [(c.col_a, c.col_b, c.r, c.direction, c.strength) for c in self.correlations]
        return small_frame(rows, "col_a string, col_b string, r double, direction string, strength string")

    def summary_frame(self) -> DataFrame:
        row = (self.file_name, self.num_rows, self.num_cols, self.num_numeric, self.num_string, self.overall_null_pct, self.total_null_cells, self.total_cells, self.is_sampled, self.correlation_skipped)
        return small_frame([row], "file_name string, num_rows long, num_cols long, num_numeric long, num_string long, overall_null_pct double, total_null_cells long, total_cells long, is_sampled boolean, correlation_skipped boolean")

    def __repr__(self) -> str:
        from ..render import overview

        return overview(self)


def confidence(c: ColumnProfile) -> float:
    """Half width of the mean's 95 % interval."""
    return 1.96 * c.stddev / math.sqrt(c.non_null_count) if c.non_null_count else 0.0


#: What a profile has beside counts, means and extremes; each costs passes of its own.
PARTS = ("distinct", "values", "shape", "correlations")


def profile_dataset(data: Dataset, correlate: bool = False, exact: bool = False, correlations: bool = True, parts=PARTS, settle=None) -> DatasetProfile:
    """Profiles a resolved dataset.

    ``parts`` names what is wanted: distinct counts, values (exact counts and
    lists where a sketch finds few), shape (spread, moments and histograms),
    correlations; the fields of parts left out keep their defaults.

    ``exact`` counts distinct values exactly whatever their number; else
    sketches estimate them, and columns with few values are counted exactly
    after that (at most 100 texts or dates, 100,000 numbers).  ``settle`` is a
    step function of a distinct count by which the caller decides: columns whose
    sketch leaves its result open are counted exactly.
    """
    began = time.perf_counter()
    df = data.df
    fields = [f for f in fields_of(df, data.misfits) if f.name in set(data.columns)]
    first = first_pass(df, fields, exact, "distinct" in parts)
    rows = first["rows"]
    numeric = [f for f in fields if f.kind in NUMERIC]
    skipped = len(numeric) > WIDE and not correlate
    paired = bool(correlations and "correlations" in parts and not skipped and rows)
    small, second, pairs = {}, {}, []
    if rows:
        with ThreadPoolExecutor(1) as pool:  # jobs of their own, so they share the cluster
            counted = pool.submit(distinct_pass, df, fields, first, exact and "distinct" in parts, "values" in parts, settle)
            if "shape" in parts or paired:
                second, pairs = second_pass(df, fields, first, paired)
            first, small = counted.result()
    second = second if "shape" in parts else {}
    columns = [_column(i, f, rows, first, small, second, exact) for i, f in enumerate(fields)]
    named = [Correlation(fields[a].name, fields[b].name, r) for a, b, r in pairs]
    found = sorted((c for c in named if abs(c.r) >= REPORT), key=lambda c: -abs(c.r))
    if data.whole is not None and data.path and not data.path.lower().endswith(".csv"):
        _override(columns, exact_extremes(data.whole, footer_figures(data.path)))
    cells, nulls = sum(c.total_count for c in columns), sum(c.null_count for c in columns)
    n_numeric = sum(f.kind in (*NUMERIC, "bool") for f in fields)
    return DatasetProfile(
        data.path or "", data.name, rows, len(fields), n_numeric, len(fields) - n_numeric, 100 * nulls / cells if cells else 0.0, nulls, cells,
        (time.perf_counter() - began) * 1000, data.sampled, columns, found, skipped,
    )


def _override(columns: list[ColumnProfile], whole: dict) -> None:
    """Nulls and extremes of a sampled Parquet table, from all its rows; other statistics stay the sample's."""
    for i, c in enumerate(columns):
        c.total_count, c.non_null_count = whole["rows"], whole[f"n{i}"]
        c.null_count = c.total_count - c.non_null_count
        c.null_pct = 100 * c.null_count / c.total_count if c.total_count else 0.0
        c.has_high_nulls = c.null_pct > 20
        if whole.get(f"low{i}") is not None:
            c.val_min, c.val_max = float(whole[f"low{i}"]), float(whole[f"high{i}"])
            c.range = c.val_max - c.val_min


def _column(i: int, f, rows: int, first: dict, small: dict, second: dict, exact: bool) -> ColumnProfile:
    c = ColumnProfile(f.name, f.kind, total_count=rows)
    c.non_null_count = first[f"n{i}"]
    c.null_count = rows - c.non_null_count
    c.type_mismatch_count = first.get(f"bad{i}", 0)
    c.null_count -= c.type_mismatch_count  # a misfit was there, it just could not be read
    c.null_pct = 100 * c.null_count / rows if rows else 0.0
    c.type_mismatch_pct = 100 * c.type_mismatch_count / rows if rows else 0.0
    known, c.top_values = small.get(i, (None, []))
    if exact and f"u{i}" in first:
        known = first[f"u{i}"]
    c.unique_approx = min(known if known is not None else first.get(f"u{i}", 0), max(c.non_null_count, 0))
    if known is not None:
        c.unique_exact, c.exact_unique_valid = known, True
    c.unique_pct = 100 * c.unique_approx / c.non_null_count if c.non_null_count else 0.0
    if c.non_null_count and f"low{i}" in first:
        c.val_min, c.val_max = float(first[f"low{i}"]), float(first[f"high{i}"])
        c.range = c.val_max - c.val_min
    if c.non_null_count and f.number is not None:
        c.mean = float(first[f"mean{i}"])
        c.zero_count = first[f"zero{i}"]
    if i in second and c.non_null_count:
        c.variance, c.skewness, c.kurtosis = shape(c.non_null_count, second[i]["s"])
        c.stddev = math.sqrt(c.variance)
        c.histogram_bins = second[i]["bins"]
    if c.non_null_count and f"short{i}" in first:
        c.min_str_len, c.max_str_len, c.mean_str_len = first[f"short{i}"], first[f"long{i}"], float(first[f"size{i}"])
    c.has_high_nulls = c.null_pct > 20
    counted = known is not None or f"u{i}" in first
    c.is_constant = counted and c.unique_approx <= 1 and f.kind != "unknown" or c.non_null_count == 0
    c.is_high_cardinality = c.unique_pct > 90
    return c


def scan(data, sample_size: int | None = None, allowed_dir: str | None = None, correlate: bool = False, exact: bool = False, sample_files: int | None = None, **csv) -> DatasetProfile:
    """The profile of a path (CSV, Parquet), Spark DataFrame or pandas-like frame; prints nothing.

    With ``sample_size``, the profile is that of so many rows, drawn from all or
    from ``sample_files`` of the table's files; nulls and extremes of Parquet
    tables are of all rows, from footers but for floats (NaN is in no footer).

    ``csv`` takes ``sep``, ``null_string``, ``header`` and ``infer_rows``.
    """
    return profile_dataset(resolve(data, sample_size, allowed_dir, sample_files, **csv), correlate, exact)


def profile(data, sample_size: int | None = None, correlate: bool = False, **options) -> DatasetProfile:
    """Scans, prints the report and returns the profile."""
    from ..render import terminal_report

    found = scan(data, sample_size, correlate=correlate, **options)
    print(terminal_report(found))
    return found
