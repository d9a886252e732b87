"""Rewrites: fixing and cleaning, as one lazy projection over the input.

The statistics that fills and clips need come from exact quantiles, which no
task holds as a whole, and counts; category codes come from joins with the
ranked distinct values, which one job finds for all columns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, as_number, quoted, type_name
from ..plans.quantiles import exact_quantiles, mode
from ..session import PrismataError, shared_dir
from ..sources.readers import Dataset, resolve
from ..sources.sinks import backup, is_folder, restore, write_audit, write_table
from .issues import collect_warnings, is_outlier, quality_score
from .profile import DatasetProfile, profile_dataset

#: Distinct values that one window numbers, about, and the most buckets that more are cut into.
BUCKET_VALUES, MOST_BUCKETS = 1_000_000, 1000


@dataclass
class Plan:
    """Steps by column, in order: (action, reason)."""

    steps: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def add(self, column: str, action: str, reason: str) -> None:
        own = self.steps.setdefault(column, [])
        if own and own[-1][0] == "drop" or any(a == action for a, _ in own):
            return
        own.append((action, reason))


def fix_plan(p: DatasetProfile) -> Plan:
    """What ``fix`` does: nulls over 1 %, outliers, ids, categories."""
    plan = Plan()
    for c in p.columns:
        if c.null_pct > 1:
            plan.add(c.name, "drop" if c.null_pct > 50 and c.type_str in ("str", "unknown") else "impute", f"{c.null_pct:.1f}% nulls")
    for c in p.columns:
        if is_outlier(c):
            plan.add(c.name, "clip", "outliers")
        if c.type_str == "int" and c.unique_pct > 95:
            plan.add(c.name, "drop", "ID column")
        if c.type_str in ("str", "unknown") and c.unique_approx > 50:
            plan.add(c.name, "encode", f"{c.unique_approx} values")
    return plan


def clean_plan(p: DatasetProfile) -> Plan:
    """What ``clean`` does: every warning's action, critical first; misfits are nulls already."""
    plan = Plan()
    for w in collect_warnings(p):
        if w["action_type"] != "drop_invalid":
            plan.add(w["column"], w["action_type"], w["message"])
    return plan


def statistics(df: DataFrame, plan: Plan) -> dict[str, dict]:
    """Median, mode, 99th percentile and what exceeds it, for the columns whose steps need them.

    The percentile is that of the column after its imputation.
    """
    kinds = {f.name: type_name(f.dataType) for f in df.schema.fields}
    filled = [n for n, steps in plan.steps.items() if "impute" in [a for a, _ in steps]]
    clipped = [n for n, steps in plan.steps.items() if "clip" in [a for a, _ in steps]]
    out: dict[str, dict] = {}
    medians = exact_quantiles(df, {(n, "fill"): (as_number(quoted(n), kinds[n]), 0.5) for n in filled if kinds[n] in NUMERIC})
    for n in filled:
        out[n] = {"fill": medians[n, "fill"] if kinds[n] in NUMERIC else mode(df, quoted(n))}
    uppers = exact_quantiles(df, {(n, "upper"): (_filled(n, kinds[n], out), 0.99) for n in clipped})
    for (n, _), x in uppers.items():
        out.setdefault(n, {})["upper"] = x
    counts = {(n, "nulls"): F.count_if(_missing(n, kinds[n])) for n in filled}
    counts |= {(n, "clipped"): F.count_if(_filled(n, kinds[n], out) > F.lit(out[n]["upper"])) for n in clipped}
    _collect(df, counts, out)
    return out


def _collect(df: DataFrame, exprs: dict, out: dict) -> None:
    if exprs:
        row = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs.values())]).first()
        for (name, key), value in zip(exprs, row):
            out.setdefault(name, {})[key] = value


def _missing(name: str, kind: str) -> Column:
    return as_number(quoted(name), kind).isNull() if kind in NUMERIC else quoted(name).isNull()


def _filled(name: str, kind: str, stats: dict) -> Column:
    c = as_number(quoted(name), kind) if kind in NUMERIC else quoted(name)
    own = stats.get(name, {})
    if "fill" not in own:
        return c
    fill = own["fill"] if own["fill"] is not None or kind in NUMERIC else "Unknown" if kind == "str" else None
    return c if fill is None else F.coalesce(c, F.lit(fill))


def ranks(values: DataFrame, per_bucket: int = BUCKET_VALUES, count: int | None = None) -> DataFrame:
    """value, code: the distinct values (column ``value``, no null) numbered from 0 in ascending order.

    Up to ``per_bucket`` values are numbered in one window.  More are cut into
    buckets at values that a hash picks (at most MOST_BUCKETS), each bucket has
    its own window, and the buckets' sizes give the offsets.
    """
    count = values.count() if count is None else count
    buckets = min(MOST_BUCKETS, count // per_bucket)
    if buckets < 2:
        return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))
    bounds = sorted(r[0] for r in values.where(F.pmod(F.xxhash64("value"), F.lit(count // buckets)) == 0).collect())
    marks = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array()
    placed = values.withColumn("bucket", F.size(F.filter(marks, lambda b: b <= F.col("value"))) if bounds else F.lit(0))
    sizes = {r[0]: r[1] for r in placed.groupBy("bucket").count().collect()}
    before, total = [], 0
    for i in range(len(bounds) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    offset = F.array(*[F.lit(x) for x in before])[F.col("bucket")]
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    return placed.select("value", (offset + at - 1).alias("code"))


def encode(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Replaces the columns' values by their rank among the column's distinct ones (from 0, ascending), null by -1; and the numbers of values.

    One scan and one shuffle make the dictionary of all columns of a type, a
    table in the shared folder; ranks and joins read a column's part of it.  The
    codes of up to BUCKET_VALUES values are broadcast, so that a frequent value
    is no hot key.
    """
    spark = df.sparkSession
    kinds: dict = {}
    for f in df.schema.fields:
        if f.name in names:
            kinds.setdefault(f.dataType, []).append(f.name)
    counts, codes = dict.fromkeys(names, 0), {}
    for kind, own in kinds.items():
        path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
        pair = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), quoted(c).alias("value")) for i, c in enumerate(own)]))
        df.select(pair.alias("pair")).select("pair.*").where("value IS NOT NULL").distinct().write.partitionBy("number").parquet(path)
        whole = T.StructType([T.StructField("value", kind), T.StructField("number", T.IntegerType())])
        for r in spark.read.schema(whole).parquet(path).groupBy("number").count().collect():
            name, values = own[r[0]], spark.read.schema(T.StructType(whole.fields[:1])).parquet(f"{path}/number={r[0]}")
            counts[name] = r[1]
            codes[name] = ranks(values, count=r[1])
    out = df.select(*[quoted(c).alias(f"__c{i}") for i, c in enumerate(df.columns)])
    for i, name in enumerate(df.columns):
        if name in codes:
            side = codes[name].select(F.col("value").alias(f"__v{i}"), F.col("code").cast("int").alias(f"__n{i}"))
            out = out.join(F.broadcast(side) if counts[name] <= BUCKET_VALUES else side, F.col(f"__c{i}") == F.col(f"__v{i}"), "left")
    code = lambda i, name: F.coalesce(F.col(f"__n{i}"), F.lit(-1)) if name in codes else F.lit(-1)
    return out.select(*[(code(i, c) if c in names else F.col(f"__c{i}")).alias(c) for i, c in enumerate(df.columns)]), counts


def apply_plan(df: DataFrame, plan: Plan) -> tuple[DataFrame, list[dict]]:
    """The rewritten frame, and what was done in the form of the audit."""
    plan = Plan({n: s for n, s in plan.steps.items() if n in df.columns})
    stats = statistics(df, plan)
    kinds = {f.name: type_name(f.dataType) for f in df.schema.fields}
    drops = {n for n, s in plan.steps.items() if s and s[-1][0] == "drop"}
    actions, cols, coded = [], [], []
    for name in df.columns:
        steps = plan.steps.get(name, [])
        own = stats.get(name, {})
        for action, reason in steps:
            if action == "drop":
                actions.append({"column": name, "action": "drop", "reason": reason})
            elif action == "impute":
                actions.append({"column": name, "action": "impute", "fill_value": str(own["fill"]), "cells_fixed": own["nulls"]})
            elif action == "clip":
                actions.append({"column": name, "action": "clip", "upper_bound": own["upper"], "cells_clipped": own["clipped"]})
        if name in drops:
            continue
        done = [a for a, _ in steps]
        c = _filled(name, kinds[name], stats) if "impute" in done else quoted(name)
        if "clip" in done:
            value = _filled(name, kinds[name], stats)
            c = F.when(value.isNotNull(), F.least(value, F.lit(own["upper"])))
        cols.append(c.alias(name))
        if "encode" in done:
            coded.append(name)
    out = df.select(*cols)
    if coded:
        out, values = encode(out, coded)
        actions += [{"column": name, "action": "encode", "unique_values": values[name]} for name in coded]
    return out, actions


def fix(data, apply: bool = False, sample_size: int | None = None) -> DataFrame | None:
    """Prints code for each fix, or applies the fixes to all rows and returns the frame; None if there is nothing to fix.

    ``sample_size`` bounds the rows that the decisions are made on.
    """
    from ..render import fix_report

    dataset = resolve(data, sample_size)
    p = profile_dataset(dataset)
    if not apply:
        found = collect_warnings(p)
        print(fix_report(p, found))
        return None
    plan = fix_plan(p)
    if not plan.steps:
        return None
    return apply_plan(dataset.data, plan)[0]


def clean(data, output: str | None = None, sample_size: int | None = None, single: bool | None = None) -> DataFrame | None:
    """Applies all fixes to all rows; writes the result (to ``output`` or over the input, after a backup) with an audit document.

    Returns the cleaned frame, or None if nothing can be fixed.  A frame as
    input is written only if ``output`` is given.  ``sample_size`` bounds the
    rows that the decisions are made on.  ``single`` tells whether the output
    is one file or a folder written in parallel; by default it is what the
    input is (one file for a frame).
    """
    from .. import __version__

    source: Dataset = resolve(data)
    p = profile_dataset(source.sample(sample_size) if sample_size else source)
    plan = clean_plan(p)
    if not plan.steps:
        print(f"{p.file_name}: nothing to fix")
        return None
    before = quality_score(p)
    cleaned, actions = apply_plan(source.data, plan)
    after_profile = profile_dataset(Dataset(cleaned, p.file_name))
    after = quality_score(after_profile, p.num_cols)
    for a in actions:
        print(f"  {a['column']}: " + ", ".join(f"{k} {v}" for k, v in a.items() if k != "column"))
    print(f"  score {before} -> {after}")
    goal = output or source.path
    if goal is not None:
        if single is None:
            single = source.path is None or not is_folder(source.path)
        if source.path is not None:
            backup(source.path)
        write_table(cleaned, goal, single)
        audit = {
            "source_file": p.file_name, "output_file": goal.rsplit("/", 1)[-1], "prismata_version": __version__, "score_before": before, "score_after": after,
            "rows_before": p.num_rows, "rows_after": after_profile.num_rows, "cols_before": p.num_cols, "cols_after": after_profile.num_cols, "actions": actions,
        }
        write_audit(goal, audit)
        if goal == source.path:
            cleaned = resolve(goal).data
    return cleaned


def undo(path: str) -> str:
    """Restores the file that ``clean`` backed up."""
    try:
        return restore(path)
    except OSError as e:
        raise PrismataError(str(e)) from e


clean.undo = undo
