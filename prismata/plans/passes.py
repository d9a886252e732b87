"""The passes of a profile.

First pass: one aggregate with counts, extremes, sums and sketches of all
columns.  Second pass: centred power sums, histograms and, for correlations, the
cross products of all numeric columns, as partial results of each task from one
scan.  Exact distinct counts of numbers, dates and times: one job for all of
them.  Distinct values: only for columns that the sketch says are small.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, as_number, present, quoted, seconds, type_name
from .partials import BINS as BINS
from .partials import distinct_keys, shapes_and_products

#: Exact distinct counts go up to these; beyond, the sketch's estimate stands.
STRING_DISTINCT, NUMBER_DISTINCT = 100, 100_000
SKETCH = 14
#: Relative error of a sketch's estimate that bounds it: six standard errors.
SKETCH_ERROR = 6 * 1.04 / 2 ** (SKETCH / 2)
#: Types whose values are 64-bit numbers, or tell as much.
KEYED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Field:
    name: str
    kind: str
    value: Column  # null where the value counts as null
    number: Column | None  # as double, for int, float and bool
    bad: Column | None  # cell that doesn't fit the type


def fields_of(df: DataFrame, misfits: dict[str, Column] | None = None) -> list[Field]:
    out = []
    for f in df.schema.fields:
        kind, c = type_name(f.dataType), quoted(f.name)
        number = as_number(c, kind) if kind in (*NUMERIC, "bool") else None
        out.append(Field(f.name, kind, present(c, kind), number, (misfits or {}).get(f.name)))
    return out


def first_pass(df: DataFrame, fields: list[Field], exact: bool, distinct: bool = True) -> dict:
    """Rows, and for each field number its count, misfits, distinct (estimate, if asked for), low, high, mean, zeros and text lengths."""
    out = [F.count(F.lit(1)).alias("rows")]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for i, f in enumerate(fields):
        out.append(F.count(f.value).alias(f"n{i}"))
        if f.bad is not None:
            out.append(F.count_if(f.bad).alias(f"bad{i}"))
        if f.kind != "unknown":
            value = f.value.cast("int") if f.kind == "bool" else f.value
            if distinct and not exact:
                key = value.cast("long") if f.kind in ("int", "bool") else F.xxhash64(value) if f.kind == "float" else value.cast("string")
                out.append(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), key), F.lit(SKETCH))).alias(f"u{i}"))
        if f.number is not None:
            out += [F.min(f.number).alias(f"low{i}"), F.max(f.number).alias(f"high{i}"), F.avg(f.number).alias(f"mean{i}"), F.count_if(f.number == 0).alias(f"zero{i}")]
        elif f.kind == "datetime":
            t = seconds(f.value, kinds[f.name])
            out += [F.min(t).alias(f"low{i}"), F.max(t).alias(f"high{i}")]
        elif f.kind == "str":
            size = F.octet_length(f.value)
            out += [F.min(size).alias(f"short{i}"), F.max(size).alias(f"long{i}"), F.avg(size).alias(f"size{i}")]
    return df.agg(*out).first().asDict()


def exact_extremes(whole: DataFrame, known: dict[str, dict] | None = None) -> dict:
    """rows, and for each field number its count and extremes over all rows.

    Columns that are ``known`` (from footers) are not read; of the others a scan
    makes min, max and count only.
    """
    known = known or {}
    fields, found, out = fields_of(whole), {}, []
    for i, f in enumerate(fields):
        if f.name in known:
            found[f"n{i}"] = known[f.name]["n"]
            if f.number is not None and known[f.name]["low"] is not None:
                found |= {f"low{i}": float(known[f.name]["low"]), f"high{i}": float(known[f.name]["high"])}
            continue
        out.append(F.count(f.value).alias(f"n{i}"))
        if f.number is not None:
            out += [F.min(f.number).alias(f"low{i}"), F.max(f.number).alias(f"high{i}")]
    if "" in known and not out:
        return found | {"rows": known[""]["rows"]}
    return found | whole.agg(F.count(F.lit(1)).alias("rows"), *out).first().asDict()


def distinct_counts(df: DataFrame, fields: list[Field], chosen: list[int], rows: int) -> dict[int, int]:
    """Exact distinct counts: one job for all numbers, dates and times; one for each text column, a few at a time."""
    narrow = [i for i in chosen if isinstance(df.schema[fields[i].name].dataType, KEYED)]
    wide = [i for i in chosen if i not in set(narrow)]
    count = lambda i: df.select(fields[i].value.alias("v")).where("v IS NOT NULL").distinct().count()
    with ThreadPoolExecutor(4) as pool:
        keyed = pool.submit(lambda: distinct_keys(df, [fields[i].value for i in narrow], rows)) if narrow else None
        found = dict(zip(wide, pool.map(count, wide)))
        return found | (dict(zip(narrow, keyed.result())) if keyed else {})


def second_pass(df: DataFrame, fields: list[Field], first: dict, products: bool = False) -> tuple[dict[int, dict], list[tuple[int, int, float]]]:
    """By field number: bins (16 counts) and centred power sums of the numeric fields with values; and, if asked for, correlations: all from one scan."""
    chosen = [i for i, f in enumerate(fields) if f.number is not None and first[f"n{i}"]]
    if not chosen:
        return {}, []
    shapes, gram = shapes_and_products(df, [fields[i].number for i in chosen], [tuple(first[f"{k}{i}"] for k in ("low", "high", "mean")) for i in chosen], products)
    paired = [k for k, i in enumerate(chosen) if fields[i].kind in NUMERIC]
    return {i: shapes[k] for k, i in enumerate(chosen)}, [(chosen[a], chosen[b], r) for a, b, r in pearson(gram, paired)] if products else []


def shape(n: int, s: list[float]) -> tuple[float, float, float]:
    """Sample variance, adjusted skewness and excess kurtosis from sums of powers about (nearly) the mean."""
    if n < 2:
        return 0.0, 0.0, 0.0
    e = s[1] / n
    m2 = s[2] / n - e * e
    m3 = s[3] / n - 3 * e * s[2] / n + 2 * e**3
    m4 = s[4] / n - 4 * e * s[3] / n + 6 * e * e * s[2] / n - 3 * e**4
    variance = max(0.0, m2) * n / (n - 1)
    if math.sqrt(variance) <= 1e-10:
        return variance, 0.0, 0.0
    skewness = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else 0.0
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) if n > 3 else 0.0
    return variance, skewness, kurtosis


def distinct_pass(df: DataFrame, fields: list[Field], first: dict, exact: bool, values: bool, settle=None) -> tuple[dict, dict[int, tuple[int, list]]]:
    """``first`` with exact distinct counts if these are asked for, and the small sets of values if they are.

    Where a sketch leaves open what ``settle`` makes of the count, it is exact too.
    """
    if exact:
        counts = distinct_counts(df, fields, [i for i, f in enumerate(fields) if f.kind != "unknown"], first["rows"])
        first = first | {f"u{i}": n for i, n in counts.items()}
    small = small_sets(df, fields, first, exact) if values else {}
    if settle and not exact:
        open_ = [i for i in range(len(fields)) if i not in small and first.get(f"u{i}") and unsettled(first[f"u{i}"], settle)]
        small |= {i: (n, []) for i, n in distinct_counts(df, fields, open_, first["rows"]).items()}
    return first, small


def unsettled(estimate: int, settle) -> bool:
    """Whether counts within the sketch's error of the estimate lead to different results of the step function."""
    return settle(max(1, math.floor(estimate / (1 + SKETCH_ERROR)))) != settle(math.ceil(estimate / (1 - SKETCH_ERROR)))


def small_sets(df: DataFrame, fields: list[Field], first: dict, exact: bool) -> dict[int, tuple[int, list]]:
    """By field number: exact distinct count, and the sorted values of text and dates with at most STRING_DISTINCT.

    Only columns whose count so far is within their bound (and a margin for the
    sketch's error) are looked at, so what is gathered is bounded.
    """
    counted, gathered = [], []
    for i, f in enumerate(fields):
        u = first.get(f"u{i}")
        if u is None:
            continue
        if f.kind in ("str", "datetime"):
            if u <= STRING_DISTINCT * 1.1:
                gathered.append(i)
        elif not exact and u <= NUMBER_DISTINCT * 1.1:
            counted.append(i)
    out: dict[int, tuple[int, list]] = {}
    if gathered:
        row = df.agg(*[F.collect_set(fields[i].value.cast("string")).alias(f"v{i}") for i in gathered]).first()
        for i in gathered:
            values = sorted(row[f"v{i}"])
            out[i] = (len(values), values if len(values) <= STRING_DISTINCT else [])
    return out | {i: (n, []) for i, n in distinct_counts(df, fields, counted, first["rows"]).items()}


def pearson(gram: np.ndarray, chosen: list[int]) -> list[tuple[int, int, float]]:
    """(column, column, r) of all pairs of the chosen columns over the rows that have both (two at least); 0 for a constant side."""
    out = []
    for k, a in enumerate(chosen):
        for b in chosen[k + 1 :]:
            ab, sa, qa, n = gram[:, a, b].tolist()
            _, sb, qb, _ = gram[:, b, a].tolist()
            if n < 2:
                continue
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            cov = ab - sa * sb / n
            tiny = lambda v, q: v <= 1e-12 * max(q, 1e-300) or v <= 0
            out.append((a, b, 0.0 if tiny(va, qa) or tiny(vb, qb) else max(-1.0, min(1.0, cov / math.sqrt(va * vb)))))
    return out
