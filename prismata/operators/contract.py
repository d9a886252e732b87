"""Data contracts: declarative rules checked against a profile or all rows."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..sources.readers import Dataset, resolve
from .profile import ColumnProfile, DatasetProfile, profile_dataset

WARNING_RULES = ("min_str_len", "max_str_len", "regex")


@dataclass
class RuleBreachDetail:
    column: str
    rule: str
    expected: str
    actual: str
    severity: str

    def __str__(self) -> str:
        return f"[{self.severity}] {self.column}: {self.rule} expected {self.expected}, got {self.actual}"


@dataclass
class ColumnValidationResult:
    column: str
    passed: bool
    breaches: list[RuleBreachDetail] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return not self.passed


@dataclass
class ValidationReport:
    columns: list[ColumnValidationResult] = field(default_factory=list)
    total_rules: int = 0
    passed_rules: int = 0
    failed_rules: int = 0
    failed: bool = False
    file_name: str = "<unknown>"

    @property
    def passed(self) -> bool:
        return not self.failed

    def all_breaches(self) -> list[RuleBreachDetail]:
        return [b for c in self.columns for b in c.breaches]

    def __repr__(self) -> str:
        lines = [f"Contract of {self.file_name}: {self.total_rules} rules, {self.passed_rules} passed, {self.failed_rules} failed"]
        lines += [f"  {b}" for b in self.all_breaches()] or ["  all rules passed"]
        return "\n".join([*lines, f"Verdict: {'FAILED' if self.failed else 'PASSED'}"])


def _row_counts(data: Dataset, rules: dict) -> dict[tuple[str, str], int]:
    """Rows that break each allowed_values and regex rule, in one aggregate."""
    exprs = {}
    for name, own in rules.items():
        if name not in data.columns:
            continue
        text = quoted(name).cast("string")
        if "allowed_values" in own:
            exprs[(name, "allowed_values")] = F.count_if(text.isNotNull() & ~text.isin([str(x) for x in own["allowed_values"]]))
        if "regex" in own and _compiles(own["regex"]):
            exprs[(name, "regex")] = F.count_if(text.isNotNull() & ~text.rlike(f"^(?:{own['regex']})"))
    if not exprs:
        return {}
    row = data.data.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs.values())]).first()
    return dict(zip(exprs, row))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _breach(rule: str, want, c: ColumnProfile, rows: dict, mode: str) -> tuple[str, str, str] | None:
    """(expected, actual, severity) if the column breaks the rule."""
    grave = "WARNING" if rule in WARNING_RULES else "CRITICAL"
    if rule == "max_null_pct":
        return None if c.null_pct <= want else (f"<= {want}%", f"{c.null_pct:.2f}%", grave)
    if rule == "min":
        return None if c.val_min >= want else (f">= {want}", f"{c.val_min}", grave)
    if rule == "max":
        return None if c.val_max <= want else (f"<= {want}", f"{c.val_max}", grave)
    if rule == "is_unique":
        if not want:
            return None
        ok = c.unique_exact == c.total_count if c.exact_unique_valid else c.unique_approx >= 0.99 * c.total_count
        return None if ok else ("all values unique", f"{c.unique_approx:,} of {c.total_count:,}", grave)
    if rule == "min_str_len":
        return None if c.min_str_len >= want else (f">= {want}", f"{c.min_str_len}", grave)
    if rule == "max_str_len":
        return None if c.max_str_len <= want else (f"<= {want}", f"{c.max_str_len}", grave)
    if rule == "allowed_values":
        allowed = {str(x) for x in want}
        if mode == "profile":
            odd = [x for x in c.top_values if x not in allowed]
            return (f"one of {sorted(allowed)}", f"also {odd[:5]}", grave) if odd else None
        n = rows.get((c.name, rule), 0)
        return (f"one of {sorted(allowed)}", f"{n:,} rows with other values", grave) if n else None
    if rule == "regex":
        if not _compiles(want):
            return "a valid pattern", f"invalid: {want}", "CRITICAL"
        if mode == "profile":
            odd = [x for x in c.top_values if not re.match(want, x)]
            return (f"match {want}", f"not {odd[:5]}", grave) if odd else None
        n = rows.get((c.name, rule), 0)
        return (f"match {want}", f"{n:,} rows don't", grave) if n else None
    return "a known rule", f"unknown rule {rule}", "CRITICAL"


def validate(data, rules: dict[str, dict], profile: DatasetProfile | None = None, fail_on_error: bool = False, mode: str = "rows") -> ValidationReport:
    """Checks rules by column; a missing column breaks all of its rules.

    ``allowed_values`` and ``regex`` are checked on all rows; in mode
    ``profile`` (the only one if just a profile is given) on the known values
    of columns with few of them.
    """
    dataset = None if data is None else resolve(data)
    if profile is None:
        profile = profile_dataset(dataset)
    if dataset is None:
        mode = "profile"
    rows = _row_counts(dataset, rules) if mode == "rows" else {}
    out = ValidationReport(file_name=profile.file_name)
    for name, own in rules.items():
        c, breaches = profile.column(name), []
        for rule, want in own.items():
            found = ("column to exist", "column not found", "CRITICAL") if c is None else _breach(rule, want, c, rows, mode)
            out.total_rules += 1
            if found:
                breaches.append(RuleBreachDetail(name, rule, *found))
        out.failed_rules += len(breaches)
        out.passed_rules += len(own) - len(breaches)
        out.columns.append(ColumnValidationResult(name, not breaches, breaches))
    out.failed = any(b.severity == "CRITICAL" for b in out.all_breaches())
    if fail_on_error and out.failed:
        print(out)
        sys.exit(1)
    return out
