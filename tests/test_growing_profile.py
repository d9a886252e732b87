import math
import os

from pyspark.sql import functions as F

import prismata as pr
from prismata.operators.drift import drift
from prismata.operators.profile import profile_dataset
from prismata.sources.readers import Dataset
from prismata.streaming.incremental import IncrementalProfile, compare_states


def rows(spark, n, shift=0):
    return spark.range(n).selectExpr("id", f"CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id * 37 % 1000 AS DOUBLE) + {shift} END AS x", f"'v' || (id % 300 + {shift}) AS s", "CAST(NULL AS INT) AS nothing")


def grown(df, path, batches=10, after=4):
    p = IncrementalProfile(str(path), merge_after=after)
    for i in range(batches):
        p.add(df.where(F.col("id") % batches == i), i)
    return p


def folders(path):
    return sorted(x for x in os.listdir(path) if x.startswith("batch=")), sorted(x for x in os.listdir(f"{path}/_merged") if not x.startswith("."))


def check(got, df):
    whole = pr.scan(df)
    for r in got:
        w = whole.column(r["column"])
        assert (r["total_count"], r["non_null_count"]) == (w.total_count, w.non_null_count)
        if r["column"] in ("id", "x"):
            assert (r["val_min"], r["val_max"]) == (w.val_min, w.val_max)
            assert all(math.isclose(r[k], getattr(w, k), rel_tol=1e-7, abs_tol=1e-7) for k in ("mean", "variance", "skewness", "kurtosis"))
            assert all(abs(q - (w.val_min + share * w.range)) < 0.02 * w.range for q, share in zip(r["quantiles"], (0.25, 0.5, 0.75)))


def test_merged_batches_equal_the_whole(spark, tmp_path):
    df = rows(spark, 5_000)
    p = grown(df, tmp_path / "p")
    check(p.columns(spark), df)
    batches, merged = folders(tmp_path / "p")
    assert len(batches) < 4 and len(merged) == 2
    for i in (0, 9):  # replays of a merged batch and of one that isn't
        p.add(df, i)
    check(p.columns(spark), df)


def test_interrupted_merge(spark, tmp_path):
    df, path = rows(spark, 1_000), tmp_path / "p"
    p = grown(df, path, batches=3, after=100)
    kept = {x: os.path.join(path, x) for x in folders_of(path)}
    saved = spark.read.parquet(kept["batch=1"]).toPandas()
    spark.createDataFrame([(0, 2)], "first long, last long").write.parquet(f"{path}/_merged/ids=0")  # stopped before the generation was whole
    check(p.columns(spark), df)
    p.merge(spark)
    check(p.columns(spark), df)
    assert len(saved) == 4 and folders_of(path) == []
    grown(df, tmp_path / "q", batches=3, after=100)
    os.rename(tmp_path / "q" / "batch=1", path / "batch=1")  # stopped before all merged batches were deleted
    check(p.columns(spark), df)
    p.merge(spark)
    check(p.columns(spark), df)


def folders_of(path):
    return sorted(x for x in os.listdir(path) if x.startswith("batch="))


def test_no_rows(spark, tmp_path):
    p = IncrementalProfile(str(tmp_path / "p"), merge_after=2)
    assert p.columns(spark) == [] and p.profile(spark).num_rows == 0
    for i in range(3):
        p.add(rows(spark, 0), i)
    assert [(r["column"], r["total_count"], r["unique_approx"]) for r in p.columns(spark)] == [("id", 0, 0), ("nothing", 0, 0), ("s", 0, 0), ("x", 0, 0)]


def test_drift_of_states(spark, tmp_path):
    one, two = rows(spark, 4_000), rows(spark, 3_000, shift=150)
    a, b = grown(one, tmp_path / "a", 4, 3), grown(two, tmp_path / "b", 3, 10)
    got = compare_states(a, b, spark)
    want = drift(*(profile_dataset(Dataset(df.select("id", "nothing", "s", "x"), "t"), correlations=False) for df in (one, two)))
    assert (got.verdict, got.schema, got.nulls) == (want.verdict, want.schema, want.nulls)
    assert [(x["col_name"], x["status"]) for x in got.shifts] == [(x["col_name"], x["status"]) for x in want.shifts] == [("nothing", "stable"), ("x", "DRIFT")]
    (x,), (y,) = ([z for z in d.shifts if z["col_name"] == "x"] for d in (got, want))
    assert math.isclose(x["mean_b"], y["mean_b"]) and abs(x["psi"] - y["psi"]) < 0.02 and abs(x["ks_stat"] - y["ks_stat"]) < 0.02
    s = next(c for c in got.categories if c["col_name"] == "s")
    assert (s["n_new"], s["n_missing"], s["jaccard"], s["margin"]) == (150, 150, 1 / 3, 0)
