import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismata.operators.profile import profile_dataset
from prismata.plans import partials
from prismata.plans.passes import distinct_counts, fields_of, pearson
from prismata.sources.readers import Dataset


def with_holes(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 3, (rows, columns))
    x[:, 1] = -x[:, 0] * 2 + 5
    x[:, 2] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    return x


@pytest.mark.parametrize("block", [1024, 3])
def test_products_are_those_of_complete_pairs(spark, monkeypatch, block):
    """All at once and by blocks of columns; columns without a value and constant ones too."""
    monkeypatch.setattr(partials, "BLOCK", block)
    monkeypatch.setattr(partials, "VALUES", 64)
    x = with_holes(300, 8)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(8)])).repartition(3)
    numbers = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(8)]
    first = [(np.nanmin(c), np.nanmax(c), np.nanmean(c)) if (~np.isnan(c)).any() else (0.0, 0.0, 0.0) for c in x.T]
    shapes, gram = partials.shapes_and_products(df, numbers, first, True)
    for a in range(8):
        own = x[~np.isnan(x[:, a]), a]
        assert sum(shapes[a]["bins"]) == len(own)
        if a not in (2, 3):
            assert shapes[a]["bins"] == np.histogram(own, 16)[0].tolist()
            assert shapes[a]["s"][2] == pytest.approx(((own - own.mean()) ** 2).sum())
    found = {(a, b): r for a, b, r in pearson(gram, list(range(8)))}
    for a in range(8):
        for b in range(a + 1, 8):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if 3 in (a, b):
                assert (a, b) not in found
            else:
                want = 0.0 if 2 in (a, b) else np.corrcoef(x[both, a], x[both, b])[0, 1]
                assert found[a, b] == pytest.approx(want, abs=1e-9)


def test_many_columns_take_one_scan(spark):
    x = with_holes(200, 150)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(150)]))
    p = profile_dataset(Dataset(df, "t"), correlate=True, parts=["shape", "correlations"])
    assert not p.correlation_skipped
    assert (p.correlations[0].col_a, p.correlations[0].col_b) == ("c0", "c1") and p.correlations[0].r == pytest.approx(-1)
    assert profile_dataset(Dataset(df, "t"), parts=["correlations"]).correlation_skipped


@pytest.mark.parametrize("held,sent", [(1 << 20, 1 << 14), (10, 3)])
def test_distinct_counts_of_all_columns_at_once(spark, monkeypatch, held, sent):
    """Also when a task sends its values often, in short lists and to many ranges."""
    monkeypatch.setattr(partials, "HELD", held)
    monkeypatch.setattr(partials, "SENT", sent)
    rng = random.Random(3)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(rng.randrange(60), pick(0.0, -0.0, 1.5, float("nan"), float("inf")), pick(True, False), pick(dt.date(2020, 1, 1), dt.date(1960, 1, 1)), pick(dt.datetime(2020, 1, 1, 2, 3, 4, 5), dt.datetime(1950, 1, 1)), pick("a", "b", ""), None, pick(2**62, -(2**62), 2**62 + 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "i long, f double, b boolean, d date, t timestamp_ntz, s string, n int, big long").repartition(3)
    fields = fields_of(df)
    found = distinct_counts(df, fields, list(range(8)), 400)
    assert found == {0: len({r[0] for r in rows}), 1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 0, 7: 3}
    assert distinct_counts(df.where("false"), fields, [0, 5], 0) == {0: 0, 5: 0}


def test_exact_profile_of_whole_numbers(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("b"))
    p = profile_dataset(Dataset(df, "t"), exact=True)
    assert [c.unique_exact for c in p.columns] == [1000, 1000]
    assert p.columns[0].histogram_bins == np.histogram(np.arange(1000), 16)[0].tolist()
