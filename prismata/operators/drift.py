"""Drift between two datasets: schema, nulls, distributions, categories."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC
from ..plans.passes import BINS
from ..sources.readers import Dataset, resolve
from .profile import ColumnProfile, DatasetProfile, profile_dataset

FLOOR = 1e-4
#: Names that tell of a target column.
TARGETS = ("survived", "target", "label", "y", "class", "outcome", "is_", "has_")


def psi(a: list[int], b: list[int]) -> float:
    """Population stability index of two histograms; shares are at least FLOOR."""
    ta, tb = sum(a), sum(b)
    if not ta or not tb or len(a) != len(b):
        return 0.0
    shares = [(max(x / ta, FLOOR), max(y / tb, FLOOR)) for x, y in zip(a, b)]
    return sum((y - x) * math.log(y / x) for x, y in shares)


def _cdf(low: float, high: float, bins: list[int]):
    """Share of values up to x, linear within bins."""
    total, width = sum(bins), (high - low) / len(bins)
    edges = [low + width * i for i in range(len(bins))] + [high]
    before = [0]
    for n in bins:
        before.append(before[-1] + n)

    def at(x: float) -> float:
        if x <= low:
            return 0.0
        if x >= high:
            return 1.0
        i = min(max(bisect_left(edges, x) - 1, 0), len(bins) - 1)
        return (before[i] + bins[i] * (x - edges[i]) / (edges[i + 1] - edges[i])) / total

    return edges, at


def ks(a: ColumnProfile, b: ColumnProfile) -> float:
    """Greatest distance of the two histograms' piecewise linear distribution functions."""
    if not sum(a.histogram_bins) or not sum(b.histogram_bins):
        return 0.0
    ea, fa = _cdf(a.val_min, a.val_max, a.histogram_bins)
    eb, fb = _cdf(b.val_min, b.val_max, b.histogram_bins)
    return max(abs(fa(x) - fb(x)) for x in sorted({*ea, *eb}))


def wasserstein(a: ColumnProfile, b: ColumnProfile) -> float:
    """First Wasserstein distance, each histogram's weight on 16 points evenly spread from least to greatest value."""
    mass: dict[float, float] = {}
    for c, sign in ((a, 1.0), (b, -1.0)):
        total = sum(c.histogram_bins)
        if not total:
            return 0.0
        step = (c.val_max - c.val_min) / (len(c.histogram_bins) - 1)
        for i, n in enumerate(c.histogram_bins):
            x = c.val_min + step * i
            mass[x] = mass.get(x, 0.0) + sign * n / total
    points = sorted(mass)
    out, gap = 0.0, 0.0
    for x, y in zip(points, points[1:]):
        gap += mass[x]
        out += abs(gap) * (y - x)
    return out


@dataclass
class Drift:
    schema: dict
    nulls: list[dict]
    shifts: list[dict]
    categories: list[dict]
    critical: int = 0
    warnings: int = 0
    verdict: str = "PASS"
    safe_to_train: str = "YES"
    lines: list[str] = field(default_factory=list)


def schema_diff(a: DatasetProfile, b: DatasetProfile) -> dict:
    ca, cb = ({c.name: c.type_str for c in p.columns} for p in (a, b))
    return {
        "count_a": a.num_cols,
        "count_b": b.num_cols,
        "missing_in_b": [x for x in ca if x not in cb],
        "missing_in_a": [x for x in cb if x not in ca],
        "type_mismatches": [(x, ca[x], cb[x]) for x in ca if x in cb and ca[x] != cb[x]],
    }


def null_drift(a: DatasetProfile, b: DatasetProfile) -> list[dict]:
    out = []
    for x in a.columns:
        y = b.column(x.name)
        if y:
            d = y.null_pct - x.null_pct
            out.append({"col_name": x.name, "null_pct_a": x.null_pct, "null_pct_b": y.null_pct, "delta": d, "status": "spike" if d > 5 else "increase" if d > 0.1 else "decrease" if d < -0.1 else "stable"})
    return out


def distribution_shift(a: DatasetProfile, b: DatasetProfile, aligned: dict[str, tuple[list[int], list[int]]] | None = None) -> list[dict]:
    """Mean shift, PSI (each side's own range), KS and Wasserstein of each numeric column of both; ids and 0/1 columns are left out.

    ``aligned`` has histograms over a common range, for ``psi_aligned``.
    """
    out = []
    for x in a.columns:
        y = b.column(x.name)
        if not y or x.type_str not in NUMERIC or y.type_str not in NUMERIC:
            continue
        if x.unique_pct > 95 or y.unique_pct > 95 or (x.unique_approx <= 2 and x.val_min == 0 and x.val_max == 1):
            continue
        d = y.mean - x.mean
        pct = d / abs(x.mean) * 100 if x.mean else 0.0 if d == 0 else math.inf
        stable, shift = abs(pct) < 5, abs(pct) >= 10
        p, k, w = psi(x.histogram_bins, y.histogram_bins), ks(x, y), wasserstein(x, y)
        if p > 0.2 or k > 0.1:
            stable, shift = False, True
        own = {"psi_aligned": psi(*aligned[x.name])} if aligned and x.name in aligned else {}
        out.append({"col_name": x.name, "mean_a": x.mean, "mean_b": y.mean, "shift_pct": pct, "is_stable": stable, "is_shift": shift, "psi": p, "ks_stat": k, "wasserstein": w, "status": "stable" if stable else "DRIFT" if shift else "SHIFT", **own})
    return out


def aligned_histograms(a: Dataset, b: Dataset, pa: DatasetProfile, pb: DatasetProfile) -> dict[str, tuple[list[int], list[int]]]:
    """Counts of both sides over 16 bins of their common range: one grouped aggregate a side, 16 rows a column."""
    from ..functions.columns import as_number, quoted, type_name

    chosen = {}
    for x in pa.columns:
        y = pb.column(x.name)
        if y and x.type_str in NUMERIC and y.type_str in NUMERIC and x.non_null_count and y.non_null_count:
            chosen[x.name] = (min(x.val_min, y.val_min), max(x.val_max, y.val_max))
    out: dict = {n: ([0] * BINS, [0] * BINS) for n in chosen}
    names = list(chosen)
    for side, data in enumerate((a, b)):
        parts = []
        for i, n in enumerate(names):
            low, high = chosen[n]
            v = as_number(quoted(n), type_name(data.df.schema[n].dataType))
            at = F.least(F.lit(BINS - 1), F.floor((v - low) / (high - low) * BINS)) if high > low else F.when(v.isNotNull(), F.lit(0))
            parts.append(F.struct(F.lit(i).alias("field"), at.cast("int").alias("bin")))
        if parts:
            for r in data.df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("bin IS NOT NULL").groupBy("field", "bin").count().collect():
                out[names[r["field"]]][side][r["bin"]] = r["count"]
    return out


def category_diff(a: DatasetProfile, b: DatasetProfile) -> list[dict]:
    """New and missing values and their Jaccard similarity where both value sets are known, else the change of the count."""
    out = []
    for name in sorted({c.name for c in a.columns} & {c.name for c in b.columns}):
        x, y = a.column(name), b.column(name)
        if {x.type_str, y.type_str} & {*NUMERIC, "bool"}:
            continue
        known = all(c.top_values or c.non_null_count == 0 for c in (x, y))
        sa, sb = set(x.top_values), set(y.top_values)
        if known and (sa or sb):
            out.append({"col_name": name, "unique_a": len(sa), "unique_b": len(sb), "new_in_b": sorted(sb - sa), "missing_in_b": sorted(sa - sb), "jaccard": len(sa & sb) / len(sa | sb), "overflowed": False})
        else:
            out.append({"col_name": name, "unique_a": x.unique_approx, "unique_b": y.unique_approx, "new_in_b": [], "missing_in_b": [], "jaccard": None, "diff_approx": y.unique_approx - x.unique_approx, "overflowed": True})
    return out


#: log2 of the entries of a sketch of values: its counts are off by 0.8 % (one standard error).
ENTRIES = 14


def _values(df, columns: list[str]) -> list:
    """Each column's values as text; NaN and infinities count as null."""
    from ..functions.columns import quoted, type_name

    out = []
    for c in columns:
        kind = type_name(df.schema[c].dataType)
        v = quoted(c)
        out.append((F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) if kind == "float" and df.schema[c].dataType.typeName() in ("float", "double") else v).cast("string"))
    return out


def set_counts(x, y) -> list:
    """Sizes of what two sketches of values (Columns) share, of what is new in the second, of what it misses, and of both together."""
    return [F.theta_sketch_estimate(z) for z in (F.theta_intersection(x, y), F.theta_difference(y, x), F.theta_difference(x, y), F.theta_union(x, y))]


def set_row(name: str, both: int, new: int, lost: int, union: int, entries: int = ENTRIES) -> dict:
    """Counts of one column; ``margin`` is three standard errors of a sketch with 2^entries entries, 0 if all values fit one."""
    margin = 0 if union < 1 << entries else math.ceil(3 * union / 2 ** (entries / 2))
    whole = both + new + lost
    return {"col_name": name, "unique_a": both + lost, "unique_b": both + new, "n_new": new, "n_missing": lost, "jaccard": both / whole if whole else None, "margin": margin}


def category_sets(a: DataFrame, b: DataFrame, columns: list[str], exact: bool = False) -> list[dict]:
    """How many distinct values each side has, are new in b or missing in it, and the Jaccard similarity, however many there are.

    By default from sketches of fixed size: one aggregate a side for all
    columns.  ``margin`` is three standard errors of each count: 0 while the
    values of both sides fit a sketch, as counts are exact then.  ``exact``
    counts the values of all columns in one shuffle, combined before it.
    Values are compared as text, nulls are no values; two sides without any
    have the similarity None.
    """
    if not columns:
        return []
    if exact:
        parts = []
        for bit, df in ((1, a), (2, b)):
            each = [F.struct(F.lit(i).alias("field"), v.alias("value")) for i, v in enumerate(_values(df, columns))]
            parts.append(df.select(F.explode(F.array(*each)).alias("x")).select("x.*", F.lit(bit).alias("side")).where("value IS NOT NULL"))
        sides = parts[0].union(parts[1]).groupBy("field", "value").agg(F.bit_or("side").alias("side"))
        found = {(r["field"], r["side"]): r["count"] for r in sides.groupBy("field", "side").count().collect()}  # three rows a column
        return [set_row(c, *(found.get((i, k), 0) for k in (3, 2, 1)), 0) for i, c in enumerate(columns)]
    one, two = (df.agg(*[F.theta_sketch_agg(v, ENTRIES).alias(f"{side}{i}") for i, v in enumerate(_values(df, columns))]) for side, df in (("a", a), ("b", b)))
    row = one.join(two).select(*[x for i in range(len(columns)) for x in set_counts(F.col(f"a{i}"), F.col(f"b{i}"))]).first()  # one row a side
    return [set_row(c, *row[4 * i : 4 * i + 4]) for i, c in enumerate(columns)]


def fill_overflowed(categories: list[dict], a: DataFrame, b: DataFrame, exact: bool = False) -> None:
    """Puts counts and similarity by ``category_sets`` to the columns whose values are too many to be listed."""
    over = {c["col_name"]: c for c in categories if c["overflowed"]}
    for found in category_sets(a, b, list(over), exact):
        over[found["col_name"]].update(found)


def looks_like_target(name: str) -> bool:
    return name.lower().startswith(TARGETS)


def training_verdict(schema: dict, shifts: list[dict], categories: list[dict] | None = None) -> dict:
    """PASS, REVIEW or FAIL: lost columns (but a target) and changed types are critical, shifts and new categories are warnings."""
    lost = schema["missing_in_b"]
    critical = sum(not looks_like_target(x) for x in lost) + len(schema["type_mismatches"])
    warnings = sum(looks_like_target(x) for x in lost) + sum(s["is_shift"] for s in shifts) + sum(bool(c["new_in_b"]) for c in categories or () if not c["overflowed"])
    verdict = "FAIL" if critical else "REVIEW" if warnings else "PASS"
    return {"verdict": verdict, "critical_errors": critical, "warnings": warnings, "safe_to_train": not critical, "message": f"{verdict}: {critical} critical, {warnings} warnings"}


def drift(a: DatasetProfile, b: DatasetProfile, aligned=None) -> Drift:
    d = Drift(schema_diff(a, b), null_drift(a, b), distribution_shift(a, b, aligned), category_diff(a, b))
    s = d.schema
    d.critical = len(s["type_mismatches"]) + sum(x["status"] == "DRIFT" for x in d.shifts)
    d.warnings = (s["count_a"] != s["count_b"]) + len(s["missing_in_a"]) + len(s["missing_in_b"]) + sum(x["status"] == "spike" for x in d.nulls)
    d.warnings += sum(x["status"] == "SHIFT" for x in d.shifts) + sum(bool(c["new_in_b"]) for c in d.categories)
    d.verdict, d.safe_to_train = ("FAIL", "NO") if d.critical else ("WARN", "REVIEW") if d.warnings else ("PASS", "YES")
    return d


def compare(data_a, data_b, sample_size: int | None = None, exact_categories: bool = False) -> Drift:
    """Profiles both, prints what drifted and returns it.

    New and missing values of columns with more than 100 of them are counted by
    sketches, or exactly if ``exact_categories``.
    """
    from ..render import drift_report

    a, b = resolve(data_a, sample_size), resolve(data_b, sample_size)
    pa, pb = profile_dataset(a), profile_dataset(b)
    found = drift(pa, pb, aligned_histograms(a, b, pa, pb))
    fill_overflowed(found.categories, a.df, b.df, exact_categories)
    print(drift_report(pa, pb, found))
    return found
