"""A self-contained HTML report."""

from __future__ import annotations

import os
from html import escape

from .functions.columns import NUMERIC
from .operators.issues import collect_warnings, is_outlier, quality_score
from .operators.ml import find_target
from .operators.profile import ColumnProfile, DatasetProfile, scan
from .render import duration, number

_STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse;width:100%}td,th{padding:4px 8px;border-bottom:1px solid #ddd;text-align:left}.flag{padding:1px 6px;border-radius:8px;background:#eee;margin-right:4px}.high{background:#f8c8c8}.ok{background:#cdebcd}svg{vertical-align:middle}"


def ring(score: int) -> str:
    length = 2 * 3.14159265 * 40
    colour = "#3a3" if score >= 80 else "#cc3" if score >= 60 else "#c33"
    return f'<svg width="100" height="100" role="img" aria-label="score {score}"><circle cx="50" cy="50" r="40" fill="none" stroke="#eee" stroke-width="10"/><circle cx="50" cy="50" r="40" fill="none" stroke="{colour}" stroke-width="10" stroke-dasharray="{length * score / 100:.1f} {length:.1f}" transform="rotate(-90 50 50)"/><text x="50" y="57" text-anchor="middle" font-size="22">{score}</text></svg>'


def histogram(bins: list[int]) -> str:
    top = max(bins, default=0)
    if not top:
        return ""
    bars = "".join(f'<rect x="{i * 8}" y="{30 - 30 * n / top:.1f}" width="7" height="{30 * n / top:.1f}" fill="#58a"/>' for i, n in enumerate(bins))
    return f'<svg width="{len(bins) * 8}" height="30">{bars}</svg>'


def flags(c: ColumnProfile, target: str | None) -> list[tuple[str, str]]:
    out = []
    if c.null_pct > 20:
        out.append(("high nulls", "high"))
    if c.is_constant:
        out.append(("constant", "high"))
    if c.name == target:
        out.append(("ML target", ""))
    if c.type_str == "int" and c.unique_pct > 95:
        out.append(("ID column", ""))
    if is_outlier(c, strict=False):
        out.append(("outliers", "high"))
    return out or [("ok", "ok")]


def label(score: int) -> str:
    return "excellent" if score >= 80 else "good" if score >= 60 else "needs work"


def html_page(p: DatasetProfile) -> str:
    """The page; every name and value is escaped and nothing is loaded from elsewhere."""
    score, target = quality_score(p), find_target(p)
    rows = []
    for c in p.columns:
        marks = "".join(f'<span class="flag {k}">{escape(t)}</span>' for t, k in flags(c, target))
        stats = f"mean {number(c.mean)}, sd {number(c.stddev)}, {number(c.val_min)} to {number(c.val_max)}" if c.type_str in (*NUMERIC, "bool") else f"length {c.min_str_len} to {c.max_str_len}" + (": " + ", ".join(c.top_values[:5]) if c.top_values else "")
        rows.append(f"<tr><td>{escape(c.name)}</td><td>{c.type_str}</td><td>{c.null_pct:.1f}%</td><td>{c.unique_approx:,}</td><td>{escape(stats)}</td><td>{histogram(c.histogram_bins)}</td><td>{marks}</td></tr>")
    pairs = "".join(f"<tr><td>{escape(r.col_a)}</td><td>{escape(r.col_b)}</td><td>{r.r:+.3f}</td><td>{r.strength}</td></tr>" for r in p.correlations)
    notes = "".join(f"<li>{w['icon']} <b>{escape(w['column'])}</b>: {escape(w['message'])}; {escape(w['fix_action'])}</li>" for w in collect_warnings(p))
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(p.file_name)}</title><style>{_STYLE}</style></head><body><h1>{escape(p.file_name)}</h1>'
        f"<p>{ring(score)} {label(score)}; {p.num_rows:,} rows, {p.num_cols} columns, {p.overall_null_pct:.1f}% nulls, scanned in {duration(p.scan_time_ms)}</p>"
        f"<h2>Columns</h2><table><tr><th>name<th>type<th>nulls<th>unique<th>statistics<th>histogram<th>flags</tr>{''.join(rows)}</table>"
        f"<h2>Correlations</h2><table>{pairs or '<tr><td>none</td></tr>'}</table><h2>Warnings</h2><ul>{notes or '<li>none</li>'}</ul></body></html>"
    )


def report(data, output: str | None = None, sample_size: int | None = None) -> str:
    """Writes the report (by default ``{name}_report.html``) and returns its absolute path."""
    p = data if isinstance(data, DatasetProfile) else scan(data, sample_size)
    stem = os.path.splitext(p.file_name)[0].strip("<>") or "report"
    path = os.path.abspath(output or f"{stem}_report.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(html_page(p))
    return path


export = report
