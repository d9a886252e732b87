"""Merging datasets: checks, union by name, keep-first de-duplication."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC, quoted
from ..session import PrismataError
from ..sources.readers import Dataset, resolve
from ..sources.sinks import is_folder, write_table
from .profile import DatasetProfile, profile_dataset

SOURCE = "prismata_source_file"
#: Sources for each word of a bit set.
WORD = 62


@dataclass
class MergeChecks:
    skipped: list[tuple[str, str]] = field(default_factory=list)
    schema: list[tuple[str, list[str], list[str]]] = field(default_factory=list)  # name, missing, extra
    overlaps: list[tuple[str, str, int]] = field(default_factory=list)
    copies: int = 0
    shifts: list[tuple[str, str, float]] = field(default_factory=list)  # column, name, percent


def overlap(a: DataFrame, b: DataFrame) -> int:
    """Distinct rows that both have, over their common columns; nulls equal nulls."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        return 0
    cols = [quoted(c) for c in common]
    return a.select(*cols).intersect(b.select(*cols)).count()


def _family(frames: list[DataFrame], types: list[dict[str, str]], members: tuple[int, ...]) -> tuple:
    """What the members are compared by: their common columns, and the types these are cast to."""
    first, *rest = (types[i] for i in members)
    common = sorted(c for c in first if all(c in t for t in rest))
    if all(first[c] == t[c] for t in rest for c in common):
        return tuple((c, first[c]) for c in common)
    sides = [frames[i].select(*[quoted(c) for c in common]) for i in members]
    return tuple(reduce(DataFrame.union, sides).dtypes)


def _row_key(columns: tuple) -> list:
    """Two 64-bit hashes of a row's values and of which of them are null."""
    values = [quoted(c).cast(t) for c, t in columns]
    values = [v + F.lit(0).cast(t) if t in ("float", "double") else v for v, (_, t) in zip(values, columns)]  # -0.0 is 0.0
    holes = F.array(*[v.isNull() for v in values])
    return [F.xxhash64(holes, *values), F.xxhash64(F.lit(1), *reversed(values), holes)]


def overlaps(frames: list[DataFrame]) -> tuple[dict[tuple[int, int], int], int]:
    """(distinct rows that each pair of frames shares, repeated rows), as by ``overlap`` of each pair.

    A pair is compared over the columns that both have.  Repeated rows are those
    beyond the first of equal ones in all frames, over the columns that all
    have.  Nulls equal nulls; columns of different types are cast as a union
    does; without common columns there are none.

    All frames go through one shuffle, of a 128-bit hash and a bit set of
    frames for each row, combined before it; two rows could be taken for one
    with probability 2^-128 a pair.  The counts by bit set that follow are
    few.  A row is sent once for each set of columns (and types) that some pair
    is compared by: once, if all frames have the same columns.
    """
    n = len(frames)
    types = [dict(f.dtypes) for f in frames]
    families: dict[tuple, int] = {}
    of: dict[tuple[int, ...], int] = {}
    for members in [*combinations(range(n), 2), tuple(range(n))]:
        if n > 1 and (columns := _family(frames, types, members)):
            of[members] = families.setdefault(columns, len(families))
    pairs = {p: 0 for p in combinations(range(n), 2)}
    if not of:
        return pairs, 0
    whole = of.get(tuple(range(n)))
    masks = [f"m{w}" for w in range((n - 1) // WORD + 1)]
    parts = []
    for i, frame in enumerate(frames):
        mine = {f for members, f in of.items() if i in members}
        bits = [F.lit(1 << i % WORD if i // WORD == w else 0).cast("long").alias(m) for w, m in enumerate(masks)]
        keys = [F.struct(F.lit(f).alias("family"), *[k.alias(f"k{j}") for j, k in enumerate(_row_key(columns))]) for columns, f in families.items() if f in mine]
        if keys:
            parts.append((frame.select(keys[0].alias("x")) if len(keys) == 1 else frame.select(F.explode(F.array(*keys)).alias("x"))).select("x.*", *bits))
    rows = reduce(DataFrame.union, parts).groupBy("family", "k0", "k1").agg(*[F.bit_or(m).alias(m) for m in masks], F.count(F.lit(1)).alias("rows"))
    held = rows.groupBy("family", *masks).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rows") - 1).alias("again"))
    sources = F.array_compact(F.array(*[F.when(F.col(masks[i // WORD]).bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0, F.lit(i)) for i in range(n)]))
    each = held.select("family", "n", "again", sources.alias("s")).select("family", "n", "again", "s", F.explode(F.concat(F.array(F.lit(-1)), "s")).alias("i"))
    both = each.select("family", "i", F.when(F.col("i") < 0, F.col("again")).otherwise(F.col("n")).alias("n"), F.explode(F.when(F.col("i") < 0, F.array("i")).otherwise(F.filter("s", lambda x: x > F.col("i")))).alias("j"))
    copies = 0
    for r in both.groupBy("family", "i", "j").agg(F.sum("n").alias("n")).collect():  # at most a row for each pair and family
        if r["i"] < 0:
            copies += r["n"] if r["family"] == whole else 0
        elif of.get((r["i"], r["j"])) == r["family"]:
            pairs[r["i"], r["j"]] = r["n"]
    return pairs, copies


def mean_shifts(first: DatasetProfile, other: DatasetProfile) -> list[tuple[str, float]]:
    """(column, percent) where the other's mean is more than 15 % off; ids and 0/1 columns are left out."""
    out = []
    for c in first.columns:
        o = other.column(c.name)
        if not o or c.type_str not in NUMERIC or o.type_str not in NUMERIC or c.type_str == "int" and c.unique_pct > 95 or c.unique_approx <= 2 or c.mean <= 0:
            continue
        pct = (o.mean - c.mean) / c.mean * 100
        if abs(pct) > 15:
            out.append((c.name, pct))
    return out


def union_keep_first(frames: list[tuple[str, DataFrame]], source: str = SOURCE, on: list[str] | None = None) -> DataFrame:
    """All rows by column name (missing ones null) with their source; of equal rows the one from the first source stays.

    ``on`` names columns that all frames have: rows that agree in these are
    equal (nulls equal nulls); of several in the first source the one with the
    least other values, in column order and nulls first, stays.

    One aggregate with a map-side minimum, so copies are combined before the shuffle.
    """
    parts = [df.select(*[quoted(c) for c in df.columns], F.lit(i).alias("__order")) for i, (_, df) in enumerate(frames)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    cols = [c for c in whole.columns if c != "__order"]
    if on is None:
        kept = whole.groupBy(*[quoted(c) for c in cols]).agg(F.min("__order").alias("__order"))
    else:
        lost = [c for c in on if any(c not in df.columns for _, df in frames)]
        if lost or not on:
            raise PrismataError(f"not in every input: {lost}" if lost else "no columns to compare rows by")
        others = [c for c in cols if c not in on]
        least = F.min(F.struct("__order", *[quoted(c).alias(f"c{i}") for i, c in enumerate(others)])).alias("__least")
        kept = whole.groupBy(*[quoted(c) for c in on]).agg(least)
        kept = kept.select(*[quoted(c) for c in on], F.col("__least.__order").alias("__order"), *[F.col(f"__least.c{i}").alias(c) for i, c in enumerate(others)])
    names = F.array(*[F.lit(n) for n, _ in frames])
    return kept.select(*[quoted(c) for c in cols], names[F.col("__order")].alias(source))


def merge(paths: list, output: str | None = "combined.csv", checks: bool = True, single: bool | None = None, on: str | list[str] | None = None) -> DataFrame:
    """Merges at least two inputs, all rows of each, prints the checks, writes ``output`` (unless None) and returns the merged frame.

    Inputs that can't be read are skipped with a message.  ``single`` tells
    whether the output is one file or a folder written in parallel; by default
    it is a folder if an input is one.  ``on``
    (columns, or "common" for those that all inputs have) tells by what rows
    are equal; by default by all columns.
    """
    if not isinstance(paths, (list, tuple)) or len(paths) < 2:
        raise PrismataError("merge needs a list of at least two inputs")
    found: list[Dataset] = []
    report = MergeChecks()
    for i, p in enumerate(paths):
        try:
            d = resolve(p)
            d.name = d.name if d.path else f"frame_{i}"
            found.append(d)
        except PrismataError as e:
            report.skipped.append((str(p), str(e)))
    if len(found) < 2:
        raise PrismataError("fewer than two readable inputs: " + "; ".join(e for _, e in report.skipped))
    if checks:
        first = found[0]
        for d in found[1:]:
            report.schema.append((d.name, [c for c in first.columns if c not in d.columns], [c for c in d.columns if c not in first.columns]))
        pairs, report.copies = overlaps([d.data for d in found])
        report.overlaps = [(found[i].name, found[j].name, n) for (i, j), n in pairs.items()]
        profiles = [profile_dataset(d, correlations=False) for d in found]
        for d, p in zip(found[1:], profiles[1:]):
            report.shifts += [(c, d.name, pct) for c, pct in mean_shifts(profiles[0], p)]
    if on == "common":
        on = [c for c in found[0].columns if all(c in d.columns for d in found[1:])]
    merged = union_keep_first([(d.name, d.data) for d in found], on=on)
    for name, why in report.skipped:
        print(f"  skipped {name}: {why}")
    for name, missing, extra in report.schema:
        print(f"  {name}: " + (f"missing {missing} extra {extra}" if missing or extra else "columns match"))
    for a, b, n in report.overlaps:
        if n:
            print(f"  {n} equal rows in {a} and {b}: the first stays")
    if report.copies:
        print(f"  {report.copies} rows repeat others in the columns that all inputs have")
    for c, name, pct in report.shifts:
        print(f"  {c}: mean of {name} is off by {pct:+.0f}%")
    if output:
        if single is None:
            single = not any(is_folder(d.path) for d in found if d.path)
        write_table(merged, output, single)
    return merged
