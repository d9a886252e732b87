"""Readiness of columns as features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import NUMERIC
from ..session import small_frame
from .issues import describe, issues_of, ml_score
from .profile import DatasetProfile, scan

ACTIONS = {"moderate_nulls": "Impute median", "high_cardinality": "One-hot encode"}


def find_target(p: DatasetProfile, target: str | None = None) -> str | None:
    """The named column, else the first 0/1 column."""
    if target is not None:
        return target if p.column(target) else None
    return next((c.name for c in p.columns if c.type_str in NUMERIC and c.val_min == 0 and c.val_max == 1 and c.unique_approx <= 2), None)


def verdicts(p: DatasetProfile, target: str | None = None) -> list[tuple[str, str, str, str]]:
    """(feature, verdict, reason, action) of each column but the target, by its first issue."""
    out = []
    for c in p.columns:
        if c.name == target:
            continue
        issues = issues_of(c)
        if not issues:
            out.append((c.name, "KEEP", "clean", "as-is"))
            continue
        kind, _, action = issues[0]
        reason = describe(c, kind)[0]
        if action == "drop":
            out.append((c.name, "DROP", reason, "Drop column"))
        else:
            out.append((c.name, "KEEP", reason, ACTIONS.get(kind, "Fix issue")))
    return out


def verdict_frame(p: DatasetProfile, target: str | None = None) -> DataFrame:
    return small_frame(verdicts(p, target), "feature string, verdict string, reason string, action string")


def ml_ready(data, target: str | None = None, sample_size: int | None = None) -> DataFrame:
    """Prints the readiness score and the verdict for each feature; returns the verdicts."""
    p = data if isinstance(data, DatasetProfile) else scan(data, sample_size)
    goal = find_target(p, target)
    rows = verdicts(p, goal)
    print(f"ML readiness of {p.file_name}: {ml_score(p)}/100" + (f", target {goal}" if goal else ", no target found"))
    for name, verdict, reason, action in rows:
        print(f"  {verdict:<4}  {name:<20} {reason}  ({action})")
    print(f"  {sum(r[1] == 'KEEP' for r in rows)} of {len(rows)} features stay")
    return verdict_frame(p, goal)
