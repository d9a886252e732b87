"""Exact quantiles and modes without holding a column's values in one buffer.

A quantile's bracket is narrowed by mergeable sketches of bounded size and by
counts, until it holds few enough rows to gather them; each round keeps about
one row in a thousand.  All quantiles share the rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bracket that are gathered (as counts by value), and the sketches' accuracy.
GATHERED, ACCURACY = 100_000, 5000


def exact_quantiles(df: DataFrame, wanted: dict[tuple, tuple[Column, float]], gathered: int = GATHERED, accuracy: int = ACCURACY) -> dict[tuple, float | None]:
    """Each wanted fraction of a numeric column, interpolated between neighbours; nulls are left out, None without values."""
    if not wanted:
        return {}
    names = {key: f"q{i}" for i, key in enumerate(wanted)}
    rows = df.select(*[c.cast("double").alias(names[key]) for key, (c, _) in wanted.items()])
    c = {key: F.col(n) for key, n in names.items()}
    step = 2 / accuracy
    guesses = [F.percentile_approx(names[key], [max(0.0, fraction - step), min(1.0, fraction + step)], accuracy).alias(names[key]) for key, (_, fraction) in wanted.items()]
    first = rows.agg(*[f(names[key]).alias(f"{names[key]}_{f.__name__}") for key in wanted for f in (F.count, F.min, F.max)], *guesses).first()
    guess = first
    n = {key: first[f"{names[key]}_count"] for key in wanted}
    at = {key: fraction * (n[key] - 1) for key, (_, fraction) in wanted.items() if n[key]}
    low, high = ({key: first[f"{names[key]}_{f}"] for key in at} for f in ("min", "max"))
    below, inside = {key: 0 for key in at}, {key: n[key] for key in at}
    open_ = [key for key in at if inside[key] > gathered and low[key] < high[key]]
    while open_:
        cut = lambda key: F.when(c[key].between(low[key], high[key]), c[key])
        if guess is None:
            share = lambda key, by: min(1.0, max(0.0, (at[key] - below[key] + by) / inside[key] + by * step))
            guess = rows.agg(*[F.percentile_approx(cut(key), [share(key, -1), share(key, 1)], accuracy).alias(names[key]) for key in open_]).first()
        counts = rows.agg(*[F.count_if(x).alias(f"{names[key]}_{i}") for key in open_ for i, x in enumerate((cut(key) < guess[names[key]][0], cut(key).between(*guess[names[key]])))]).first()
        still = []
        for key in open_:
            (a, b), less, held = guess[names[key]], counts[f"{names[key]}_0"], counts[f"{names[key]}_1"]
            k, over = math.floor(at[key]) - below[key], inside[key] - less - held
            up, down = less <= k, math.ceil(at[key]) - below[key] < less + held  # else the sketch was off, and that end stays
            low[key], high[key] = a if up else low[key], b if down else high[key]
            now = inside[key] - (less if up else 0) - (over if down else 0)
            below[key] += less if up else 0
            if now > gathered and low[key] < high[key] and now < inside[key]:
                still.append(key)
            inside[key] = now
        open_, guess = still, None
    out: dict[tuple, float | None] = {key: None for key in wanted}
    for key, place in at.items():
        if low[key] == high[key]:
            out[key] = low[key]
            continue
        seen = sorted(map(tuple, rows.where(c[key].between(low[key], high[key])).groupBy(names[key]).count().collect()))
        ends, total = [], below[key]
        for _, times in seen:
            total += times
            ends.append(total)
        value = lambda rank: next(v for (v, _), end in zip(seen, ends) if rank < end)
        a, b = value(math.floor(place)), value(math.ceil(place))
        out[key] = a + (b - a) * (place - math.floor(place))
    return out


def mode(df: DataFrame, column: Column):
    """The most frequent value, the least of several; None without values."""
    counts = df.select(column.alias("v")).where("v IS NOT NULL").groupBy("v").count()
    found = counts.orderBy(F.desc("count"), "v").first()
    return found and found[0]
