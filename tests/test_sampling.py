import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import prismata as pr
from prismata.operators.profile import confidence, profile_dataset
from prismata.sources.footers import footer_figures
from prismata.sources.readers import resolve, spread


def bytes_read(spark, work):
    """What ``work`` returns, and the bytes that its tasks read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(store.executorList(True).apply(i).totalInputBytes() for i in range(store.executorList(True).size()))
    before = total()
    return work(), total() - before


def test_sample_covers_a_sorted_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 200_000, 1, 8).write.parquet(path)
    ids = np.array([r[0] for r in resolve(path, sample_size=4000).df.collect()])
    assert len(ids) == 4000 == len(set(ids.tolist()))
    tenths = np.bincount(ids // 20_000, minlength=10)
    assert tenths.min() > 300 and tenths.max() < 500 and ids.max() > 199_000 and ids.min() < 1000


def test_mean_lies_in_its_interval(spark):
    df = spark.range(20_000).select((F.col("id") * 1.0).alias("x")).cache()
    inside = 0
    for seed in range(40):
        x = np.array([r[0] for r in resolve(df).sample(500, seed).df.collect()])
        inside += abs(x.mean() - 9999.5) <= 1.96 * x.std(ddof=1) / math.sqrt(len(x))
    assert inside >= 34
    p = profile_dataset(resolve(df, sample_size=500))
    assert abs(p.column("x").mean - 9999.5) <= 3 * confidence(p.column("x"))


def test_files_that_are_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 400_000, 1, 40).select("id", (F.col("id") * 3 % 1009).alias("x")).write.parquet(path)
    whole = 400_000 * 399_999 / 2
    (few, n_few), (all_, n_all) = (bytes_read(spark, lambda f=f: resolve(path, sample_size=2000, sample_files=f)) for f in (8, None))
    got, read_few = bytes_read(spark, lambda: [r["id"] for r in few.df.collect()])
    _, read_all = bytes_read(spark, lambda: all_.df.collect())
    assert len(got) == 2000 and len({i // 10_000 for i in got}) == 8
    assert sum(got) * few.weight == pytest.approx(whole, rel=0.15)
    assert read_few < read_all / 3
    assert pr.scan(path, sample_size=2000, sample_files=8).column("id").val_max == 399_999


def test_spread_files():
    names = [f"f{i}" for i in range(100)]
    for seed in range(20):
        got = [int(x[1:]) for x in spread(names, 7, seed)]
        assert len(set(got)) == 7 and max(b - a for a, b in zip(got, got[1:])) <= 15 and got[0] < 15 and got[-1] >= 85
    assert spread(names[:3], 9, 1) == names[:3] and spread([], 3, 1) == []


def test_footers_tell_without_data(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    os.mkdir(path)
    for k in range(3):
        n = 50_000
        rows = {
            "i": [None if j % 10 == 0 else j + k * n for j in range(n)], "b": [j % 2 == 0 for j in range(n)], "s": ["x" * 5000 if j == 7 else None if j % 4 == 0 else f"s{j}" for j in range(n)],
            "f": [float("nan") if j % 5 == 0 else float("inf") if j == 1 else float(j) for j in range(n)], "l": [[] if j % 3 else None for j in range(n)], "all": pa.nulls(n, pa.int64()),
        }
        pq.write_table(pa.table(rows | {"l": pa.array(rows["l"], pa.list_(pa.int64()))}), f"{path}/{k}.parquet", row_group_size=10_000, write_statistics=["i", "b", "s", "f"] if k == 1 else True)
    found, read = bytes_read(spark, lambda: footer_figures(path))
    assert found["i"] == {"n": 135_000, "low": 1, "high": 149_999} and found["b"] == {"n": 150_000, "low": False, "high": True} and found["s"]["n"] == 112_500
    assert "f" not in found and "l" not in found and "all" not in found  # NaN, lists, and a file without statistics
    assert read < sum(os.path.getsize(f"{path}/{k}.parquet") for k in range(3)) / 10
    p = pr.scan(path, sample_size=1000)
    assert p.column("i").null_count == 15_000 and p.column("i").val_max == 149_999
    assert p.column("f").null_count == 3 * 10_001 and p.column("f").val_max == 49_999
    assert p.column("all").null_count == 150_000 and p.column("s").null_count == 37_500
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
