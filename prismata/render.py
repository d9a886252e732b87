"""Text reports."""

from __future__ import annotations

import sys

from .functions.columns import NUMERIC
from .operators.issues import SEVERITIES, collect_warnings, quality_label, quality_score
from .operators.profile import ColumnProfile, DatasetProfile, confidence

BLOCKS = "  ▂▃▄▅▆▇█"
PLAIN_BLOCKS = " .:-+=#%@"


def unicode_output() -> bool:
    try:
        "█▂".encode(getattr(sys.stdout, "encoding", None) or "utf-8")
    except (UnicodeEncodeError, LookupError):
        return False
    return True


def number(x: float, whole: bool = False) -> str:
    size = abs(x)
    if x == 0:
        return "0"
    if whole:
        return f"{int(x):,}"
    return f"{x:,.0f}" if size >= 1e6 else f"{x:,.1f}" if size >= 1e3 else f"{x:.4f}" if size >= 1 else f"{x:.6f}" if size >= 1e-3 else f"{x:.2e}"


def interval(x: float) -> str:
    size = abs(x)
    return "0" if x == 0 else f"{x:,.1f}" if size >= 1e3 else f"{x:.1f}" if size >= 1 else f"{x:.2f}" if size >= 0.01 else f"{x:.2g}"


def duration(ms: float) -> str:
    return f"{ms / 1000:.1f} sec" if ms >= 10_000 else f"{ms:.0f} ms"


def bar(score: float) -> str:
    full = max(0, min(10, int(score) // 10))
    return "█" * full + "░" * (10 - full) if unicode_output() else "=" * full + "-" * (10 - full)


def sparkline(bins: list[int]) -> str:
    """Eight characters; 16 bins are added up in pairs."""
    if not any(bins):
        return "-"
    if len(bins) == 16:
        bins = [a + b for a, b in zip(bins[::2], bins[1::2])]
    blocks = BLOCKS if unicode_output() else PLAIN_BLOCKS
    top = max(bins)
    return "".join(blocks[max(1, min(8, round(n / top * 8)))] if n else " " for n in bins)


def shape_of(c: ColumnProfile, rows: int) -> str:
    """A split for few values, else a word for the distribution."""
    u = c.unique_exact if c.exact_unique_valid else c.unique_approx
    if 0 < u <= 5 and c.non_null_count:
        if u == 2 and c.val_min == 0 and c.val_max == 1:
            one = round(c.mean * 100)
            return f"0: {100 - one}% | 1: {one}%"
        full = [b for b in c.histogram_bins if b]
        if 2 <= len(full) <= 3:
            shares = [round(b / c.non_null_count * 100) for b in full[:-1]]
            shares.append(max(0, 100 - sum(shares)))
            first = 0 if len(full) == 2 else 1
            return " | ".join(f"{i + first}: {s}%" for i, s in enumerate(shares))
    if rows and (u >= rows or c.is_high_cardinality):
        return "Uniform"
    s = c.skewness
    return "Right-Skewed" if s > 1.2 else "Left-Skewed" if s < -1.2 else "Normal" if abs(s) <= 0.5 else "Skewed"


def overview(p: DatasetProfile) -> str:
    lines = [
        f"DatasetProfile '{p.file_name}'", "-" * 52,
        f"  rows     {p.num_rows:,}", f"  columns  {p.num_cols} ({p.num_numeric} numeric, {p.num_string} other)",
        f"  nulls    {p.overall_null_pct:.1f}% ({p.total_null_cells:,} cells)", f"  scanned  {duration(p.scan_time_ms)}, sampled {p.is_sampled}",
        f"  pairs    {len(p.correlations)} with |r| >= 0.5",
    ]
    for c in p.columns[:3]:
        stat = f"mean={c.mean:.4g}" if c.type_str in NUMERIC else f"len~{c.mean_str_len:.0f}"
        lines.append(f"  {c.name:<16} {c.type_str:<8} null={c.null_pct:.1f}%  {stat}")
    if len(p.columns) > 3:
        lines.append(f"  and {len(p.columns) - 3} more columns")
    return "\n".join(lines)


def terminal_report(p: DatasetProfile) -> str:
    score = quality_score(p)
    out = [f"{p.file_name}: {p.num_rows:,} rows, {p.num_cols} columns, scanned in {duration(p.scan_time_ms)}" + (" (sampled)" if p.is_sampled else "")]
    out.append(f"Quality {score}/100 {bar(score)} {quality_label(score)}")
    out.append(f"{'column':<20} {'type':<9} {'null %':>7} {'unique':>10} {'mean':>14} {'min':>14} {'max':>14}  shape")
    for c in p.columns:
        if c.type_str in (*NUMERIC, "bool"):
            whole = c.type_str == "int"
            mean = number(c.mean) + (f" ±{interval(confidence(c))}" if p.is_sampled else "")
            cells = f"{mean:>14} {number(c.val_min, whole):>14} {number(c.val_max, whole):>14}  {sparkline(c.histogram_bins)} {shape_of(c, p.num_rows)}"
        else:
            cells = f"{'':>14} {c.min_str_len:>14} {c.max_str_len:>14}  {', '.join(c.top_values[:3])[:30]}"
        out.append(f"{c.name[:20]:<20} {c.type_str:<9} {c.null_pct:>7.1f} {c.unique_approx:>10,} {cells}")
    for r in p.correlations[:5]:
        out.append(f"  {r.col_a} ~ {r.col_b}: r={r.r:+.2f} {r.direction} {r.strength}")
    if p.correlation_skipped:
        out.append("  correlations skipped: too many numeric columns (correlate=True computes them)")
    found = collect_warnings(p)
    out.append(f"{len(found)} warnings" if found else "no warnings")
    return "\n".join(out)


def warnings_report(p: DatasetProfile, found: list[dict], fixes: bool = False) -> str:
    counts = ", ".join(f"{sum(w['severity'] == s for w in found)} {s}" for s in SEVERITIES)
    out = [f"{p.file_name}: {counts}"]
    out += [f"  {w['icon']} {w['column']}: {w['message']}; {w['fix_action']}" for w in found]
    if fixes and found:
        out += ["", *dict.fromkeys(w["fix_code"] for w in found)]
    if found:
        out.append(f"{100 * sum(w['auto_fixable'] for w in found) / len(found):.0f}% can be fixed by clean()")
    return "\n".join(out)


def fix_report(p: DatasetProfile, found: list[dict]) -> str:
    if not found:
        return f"{p.file_name}: nothing to fix"
    groups = {"Nulls": ("impute", "drop_invalid"), "Outliers": ("clip",), "Columns to drop": ("drop",), "Encoding": ("encode",)}
    out = ["from pyspark.sql import functions as F, Window"]
    for head, actions in groups.items():
        own = [w for w in found if w["action_type"] in actions]
        if own:
            out += [f"# {head}"] + [f"{w['fix_code']}  # {w['message']}" for w in own]
    return "\n".join(out)


def drift_report(a: DatasetProfile, b: DatasetProfile, d) -> str:
    s = d.schema
    out = [f"{a.file_name} -> {b.file_name}", "Schema"]
    out.append(f"  columns {s['count_a']} / {s['count_b']}" + ("" if s["count_a"] == s["count_b"] else "  MISMATCH"))
    out += [f"  {x}: MISSING in {b.file_name}" for x in s["missing_in_b"]] + [f"  {x}: MISSING in {a.file_name}" for x in s["missing_in_a"]]
    out += [f"  {x}: {t} vs {u}  TYPE MISMATCH" for x, t, u in s["type_mismatches"]]
    out.append("Null rates")
    out += [f"  {x['col_name']}: {x['null_pct_a']:.1f}% -> {x['null_pct_b']:.1f}%  {x['status']}" for x in d.nulls]
    out.append("Distributions")
    for x in d.shifts:
        out.append(f"  {x['col_name']}: mean {number(x['mean_a'])} -> {number(x['mean_b'])}  {x['status']} (mean: {x['shift_pct']:+.1f}%, PSI: {x['psi']:.3f}, KS: {x['ks_stat']:.3f}, WD: {x['wasserstein']:.2f})")
    if d.categories:
        out.append("Categories")
    for c in d.categories:
        if c["overflowed"]:
            known = f", {c['n_new']} new, {c['n_missing']} missing (each +-{c['margin']}), Jaccard {c['jaccard']:.2f}" if c.get("n_new") is not None and c["jaccard"] is not None else ""
            out.append(f"  {c['col_name']}: about {c['unique_a']} vs {c['unique_b']} values{known}")
        else:
            out.append(f"  {c['col_name']}: {len(c['new_in_b'])} new {c['new_in_b'][:3]}, {len(c['missing_in_b'])} missing, Jaccard {c['jaccard']:.2f}")
    out += ["Verdict", f"  {d.verdict}: {d.critical} critical, {d.warnings} warnings. Safe to train: {d.safe_to_train}"]
    return "\n".join(out)
