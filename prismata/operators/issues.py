"""Issues of columns, their fixes, and the scores made of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC, outlier
from .profile import ColumnProfile, DatasetProfile, scan

SEVERITIES = ("critical", "warning", "info")
ICONS = {"critical": "✗", "warning": "⚠", "info": "ℹ"}


def is_outlier(c: ColumnProfile, strict: bool = True) -> bool:
    return bool(outlier(lambda k: getattr(c, k), strict))


@dataclass(frozen=True)
class Rule:
    """An issue: when a column has it, and what to tell of it (fields of the column are filled in)."""

    kind: str
    severity: str
    action: str
    test: Callable[[ColumnProfile], bool]
    message: str
    advice: str


def _is_text(c: ColumnProfile) -> bool:
    return c.type_str in ("str", "unknown")


#: In the order in which they are reported.
RULES = [
    Rule("type_mismatch", "critical", "drop_invalid", lambda c: c.type_mismatch_count > 0, "{type_mismatch_count:,} cells could not be read as {type_str}", "they are treated as missing"),
    Rule("high_nulls", "critical", "drop", lambda c: c.null_pct > 50, "more than half of the cells are empty ({null_pct:.1f}%)", "leave the column out, there is too little to fill it from"),
    Rule("moderate_nulls", "critical", "impute", lambda c: c.null_pct > 5, "{null_pct:.1f}% of the cells are empty", "fill them with the {fill}"),
    Rule("id_like", "critical", "drop", lambda c: c.type_str == "int" and c.unique_pct > 95, "whole numbers that hardly repeat ({unique_pct:.1f}% distinct), like a key", "leave the column out, a model can only memorise it"),
    Rule("id_like_string", "warning", "drop", lambda c: _is_text(c) and c.unique_pct > 80, "texts that hardly repeat ({unique_approx:,} distinct), like a key", "leave the column out, a model can only memorise it"),
    Rule("high_cardinality", "warning", "encode", lambda c: _is_text(c) and c.unique_approx > 50, "{unique_approx:,} categories", "replace each by a number"),
    Rule("constant", "info", "drop", lambda c: c.is_constant, "the same value in every row", "leave the column out, it tells rows apart nowhere"),
    Rule("outlier", "info", "clip", is_outlier, "the greatest value, {val_max:,.1f}, is over ten times the mean", "cap values at the 99th percentile"),
]
_BY_KIND = {r.kind: r for r in RULES}


def issues_of(c: ColumnProfile) -> list[tuple[str, str, str]]:
    return [(r.kind, r.severity, r.action) for r in RULES if r.test(c)]


def fix_code(c: ColumnProfile, action: str) -> str:
    """PySpark code for an action; names are quoted, so a hostile one stays a name."""
    name = repr(c.name)
    col = f"F.col({('`' + c.name.replace('`', '``') + '`')!r})"
    change = lambda value: f"df = df.withColumn({name}, {value})"
    scalar = lambda what: f"F.lit(df.agg({what}).first()[0])"
    if action == "drop_invalid":
        return f"# nothing to do: {c.type_mismatch_count} values are null already"
    if action == "impute":
        return change(f"F.coalesce({col}, {scalar(f'F.median({col})' if c.type_str in NUMERIC else f'F.mode({col}, True)')})")
    if action == "encode":
        return f"codes = df.select({col}.alias('v')).where('v IS NOT NULL').distinct().withColumn('code', F.row_number().over(Window.orderBy('v')) - 1)"
    if action == "clip":
        return change(f"F.least({col}, {scalar(f'F.percentile({col}, 0.99)')})")
    return f"df = df.drop({name})"


def describe(c: ColumnProfile, kind: str) -> tuple[str, str, str]:
    """Message, what to do, and PySpark code that does it."""
    rule, values = _BY_KIND[kind], vars(c) | {"fill": "median" if c.type_str in NUMERIC else "most frequent value"}
    return rule.message.format(**values), rule.advice.format(**values), fix_code(c, rule.action)


def collect_warnings(profile: DatasetProfile) -> list[dict]:
    """All issues as dicts, critical first; within a severity by column, then in the order of the rules."""
    found = []
    for c in profile.columns:
        for kind, severity, action in issues_of(c):
            message, fix, code = describe(c, kind)
            found.append(dict(icon=ICONS[severity], column=c.name, message=message, category=kind, severity=severity, fix_code=code, fix_action=fix, action_type=action, auto_fixable=True))
    return sorted(found, key=lambda w: SEVERITIES.index(w["severity"]))


def warnings_frame(columns: DataFrame) -> DataFrame:
    """The same rules as Column expressions over rows of ``DatasetProfile.columns_frame``: column, category, severity, action_type."""
    c = F.col
    text = c("type_str").isin("str", "unknown")
    tests = {
        "type_mismatch": c("type_mismatch_count") > 0,
        "high_nulls": c("null_pct") > 50,
        "moderate_nulls": c("null_pct") > 5,
        "id_like": (c("type_str") == "int") & (c("unique_pct") > 95),
        "id_like_string": text & (c("unique_pct") > 80),
        "high_cardinality": text & (c("unique_approx") > 50),
        "constant": c("is_constant"),
        "outlier": outlier(F.col),
    }
    made = [F.when(tests[r.kind], F.struct(F.lit(r.kind).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action_type"))) for r in RULES]
    rows = columns.select(c("name").alias("column"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return rows.select("column", "x.category", "x.severity", "x.action_type")


def warnings(data, sample_size: int | None = None, show_fixes: bool = False) -> list[dict]:
    """Prints the issues by severity (with code for fixes on demand) and returns them."""
    from ..render import warnings_report

    profile = data if isinstance(data, DatasetProfile) else scan(data, sample_size)
    found = collect_warnings(profile)
    print(warnings_report(profile, found, show_fixes))
    return found


def quality_score(p: DatasetProfile, original_cols: int | None = None) -> int:
    """100 less capped penalties for dropped columns, nulls, sparse, constant and outlier columns."""
    lost = max(0, (original_cols or p.num_cols) - p.num_cols)
    score = 100 - min(20, 5 * lost) - min(40, int(2 * p.overall_null_pct))
    score -= min(20, 5 * sum(c.has_high_nulls for c in p.columns)) + min(20, 10 * sum(c.is_constant for c in p.columns)) + min(20, 3 * sum(is_outlier(c) for c in p.columns))
    return max(0, min(100, score))


def quality_label(score: float) -> str:
    return "PRISTINE" if score >= 95 else "GOOD" if score >= 80 else "FAIR" if score >= 60 else "POOR"


def ml_score(p: DatasetProfile) -> int:
    """100 less penalties for what harms training: nulls, ids, many categories, outliers, collinearity."""
    score = 100
    for c in p.columns:
        score -= 15 if c.null_pct > 50 else 10 if c.null_pct > 5 else 0
        if c.type_str == "int" and c.unique_pct > 95:
            score -= 5
        if c.type_str in ("str", "unknown"):
            score -= 5 if c.unique_approx > 0.8 * p.num_rows else 3 if c.unique_approx > 100 else 0
        score -= 5 * is_outlier(c, strict=False)
    score -= 10 * any(abs(r.r) >= 0.95 for r in p.correlations)
    return max(0, min(100, score))


def ml_score_by_first_issue(p: DatasetProfile) -> dict:
    """The other way to score: each column counts once, by its gravest trait; with advice."""
    score, issues, drop, good = 100, [], [], []
    for c in p.columns:
        if c.null_pct > 50:
            cost, what, gone = 15, f"{c.null_pct:.0f}% nulls", True
        elif c.null_pct > 5:
            cost, what, gone = 10, f"{c.null_pct:.0f}% nulls", False
        elif c.type_str == "int" and c.unique_pct > 95:
            cost, what, gone = 5, "ID column", True
        elif c.type_str in ("str", "unknown") and c.unique_approx > 0.8 * p.num_rows:
            cost, what, gone = 5, "ID-like string", True
        elif c.type_str in ("str", "unknown") and c.unique_approx > 100:
            cost, what, gone = 3, "many categories", False
        elif c.is_constant:
            cost, what, gone = 2, "constant", True
        elif is_outlier(c, strict=False):
            cost, what, gone = 2, "outliers", False
        else:
            good.append(c.name)
            continue
        score -= cost
        issues.append({"column": c.name, "issue": what, "cost": cost})
        if gone:
            drop.append(c.name)
    score -= 10 * any(abs(r.r) >= 0.95 for r in p.correlations)
    return {"score": max(0, min(100, score)), "issues": issues, "drop_cols": drop, "recommended_feature_count": p.num_cols - len(drop), "good": good}
