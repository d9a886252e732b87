import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import prismata as pr
from prismata.cli import main
from prismata.operators.ask import NOT_CONFIGURED, answer, answer_offline
from prismata.operators.drift import psi, training_verdict, wasserstein
from prismata.operators.profile import ColumnProfile, profile_dataset
from prismata.operators.transform import encode, ranks
from prismata.plans.quantiles import exact_quantiles, mode
from prismata.sources.readers import resolve


def write(path, frame):
    frame.to_csv(path, index=False)
    return str(path)


@pytest.fixture
def messy(tmp_path):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"id": range(200), "amount": [100_000, *rng.integers(-10, 30, 199)], "age": [None if i % 8 == 0 else float(20 + i % 30) for i in range(200)], "city": ["a" if i % 3 else "b" for i in range(200)], "key": [f"k{i % 120}" for i in range(200)]})
    return write(tmp_path / "messy.csv", f)


def test_clean_audit_undo(spark, messy, tmp_path):
    before = open(messy).read()
    out = str(tmp_path / "out.csv")
    df = pr.clean(messy, out)
    assert "id" not in df.columns and df.where("age IS NULL").count() == 0 and "key" in df.columns
    audit = json.load(open(tmp_path / "out.audit.json"))
    assert audit["rows_before"] == audit["rows_after"] == 200 and audit["score_after"] >= 0
    assert {a["action"] for a in audit["actions"]} >= {"drop", "impute", "encode", "clip"}
    assert pd.read_csv(out).amount.max() < 100_000
    pr.clean(messy)
    assert open(messy).read() != before
    pr.clean.undo(messy)
    assert open(messy).read() == before
    with pytest.raises(pr.PrismataError):
        pr.clean.undo(messy)


def test_clean_nothing(spark, tmp_path):
    assert pr.clean(write(tmp_path / "ok.csv", pd.DataFrame({"a": [1, 2, 1, 2, 3, 3]}))) is None


def test_garbage_numbers(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("A,B\n" + "".join(f"{'4a' if i == 3 else '' if i % 10 == 0 else i % 3 + 1},{i % 2}\n" for i in range(120)))
    p = pr.scan(str(path)).column("A")
    assert (p.type_str, p.null_count, p.type_mismatch_count) == ("int", 12, 1)
    df = pr.clean(str(path), str(tmp_path / "o.csv"))
    rows = [float(r.A) for r in df.select("A").collect()]
    assert len(rows) == 120 and rows.count(2.0) == sum(i % 3 == 1 and i % 10 != 0 and i != 3 for i in range(120)) + 13


def test_fix(spark, messy, capsys):
    assert pr.fix(messy) is None and "F.least" in capsys.readouterr().out
    df = pr.fix(messy, apply=True)
    assert "id" not in df.columns and df.where("age IS NULL").count() == 0


def test_rewrites_keep_all_rows_whatever_the_sample(spark, tmp_path):
    f = pd.DataFrame({"id": range(1000), "v": [None if i % 9 == 0 else float(i % 50) for i in range(1000)], "w": [i % 7 for i in range(1000)]})
    path = write(tmp_path / "t.csv", f)
    assert pr.scan(path, sample_size=50).num_rows == 50
    assert pr.fix(path, apply=True, sample_size=50).count() == 1000
    assert pr.clean(path, sample_size=50).count() == 1000 and len(pd.read_csv(path)) == 1000
    assert json.load(open(tmp_path / "t.audit.json"))["rows_after"] == 1000
    pr.clean.undo(path)
    other = write(tmp_path / "u.csv", f.assign(id=range(2000, 3000)))
    assert pr.merge([path, other], None, checks=False).count() == 2000
    assert pr.validate(resolve(other, sample_size=50), {"w": {"regex": "[0-5]"}}).failed is False
    assert "142 rows" in str(pr.validate(resolve(other, sample_size=50), {"w": {"regex": "[0-5]"}}).all_breaches()[0])


def test_output_in_parts_and_other_stores(spark, messy, tmp_path):
    goal = str(tmp_path / "parts.csv")
    assert pr.clean(messy, goal, single=False) is not None and (tmp_path / "parts.csv").is_dir()
    assert pr.scan(goal).num_rows == 200
    url = f"file://{messy}"
    before = open(messy).read()
    pr.clean(url)
    assert open(messy).read() != before and (tmp_path / "messy.audit.json").exists()
    with open(messy, "a") as f:  # another tool edits the file: no stale checksum is in the way
        f.write("")
    assert not list(tmp_path.glob(".*.crc")) and pr.scan(url).num_rows == 200
    pr.clean.undo(url)
    assert open(messy).read() == before
    df = pd.read_csv(messy)
    path = str(tmp_path / "m.parquet")
    pr.merge([df, df.assign(id=df.id + 1000)], path, single=False)
    assert (tmp_path / "m.parquet").is_dir() and pr.scan(path).num_rows == 400
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no table")
    assert pr.merge([df, str(tmp_path / "bad.parquet"), df], None).count() == 200


@pytest.mark.parametrize("gathered,accuracy", [(100_000, 5000), (50, 100), (10, 20)])
def test_exact_quantiles(spark, gathered, accuracy):
    rng = np.random.default_rng(3)
    cols = {"normal": rng.normal(size=5000), "heavy": rng.pareto(0.3, 5000), "few": rng.integers(0, 3, 5000).astype(float), "one": np.full(5000, 7.0), "holes": np.where(rng.random(5000) < 0.4, np.nan, rng.random(5000))}
    df = spark.createDataFrame(pd.DataFrame(cols)).withColumn("holes", F.nanvl("holes", F.lit(None).cast("double")))
    wanted = {(c, q): (F.col(c), q) for c in cols for q in (0.0, 0.25, 0.5, 0.99, 1.0)} | {("none", 0.5): (F.lit(None).cast("double"), 0.5)}
    got = exact_quantiles(df, wanted, gathered, accuracy)
    assert got.pop(("none", 0.5)) is None
    for (c, q), x in got.items():
        assert x == pytest.approx(np.nanquantile(cols[c], q), rel=1e-9), (c, q)
    assert mode(df, F.col("few")) == min(range(3), key=lambda k: (-(cols["few"] == k).sum(), k)) and mode(df, F.lit(None)) is None


def test_encode_ranks_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    assert sorted(r.v for r in encode(df, ["v"])[0].collect()) == [-1, 0, 0, 1, 2]


def test_ranks_in_buckets(spark):
    values = spark.range(3000).selectExpr("'v' || id AS value")
    for per in (10_000, 100, 7):
        assert {r.value: r.code for r in ranks(values, per).collect()} == {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(3000)))}


def test_compare(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    a = write(tmp_path / "a.csv", pd.DataFrame({"score": rng.normal(50, 10, 1000).round().astype(int), "kind": ["x", "y"] * 500}))
    b = write(tmp_path / "b.csv", pd.DataFrame({"score": rng.normal(60, 15, 1000).round().astype(int), "kind": ["x", "z"] * 500, "more": [1] * 1000}))
    d = pr.compare(a, b)
    s = d.shifts[0]
    assert s["status"] == "DRIFT" and s["psi"] > 0 and s["ks_stat"] > 0.1 and s["wasserstein"] > 5 and s["psi_aligned"] > 0.2
    assert d.categories[0]["new_in_b"] == ["z"] and d.schema["missing_in_a"] == ["more"] and d.verdict == "FAIL"
    out = capsys.readouterr().out
    assert "PSI" in out and "KS" in out and "WD" in out
    assert pr.compare(a, a).verdict == "PASS"


def test_distances():
    assert psi([5, 5], [5, 5]) == 0 and psi([10, 0], [0, 10]) > 1
    a = ColumnProfile("x", "int", val_min=0, val_max=15, histogram_bins=[1] * 16)
    b = ColumnProfile("x", "int", val_min=2, val_max=17, histogram_bins=[1] * 16)
    assert wasserstein(a, b) == pytest.approx(2)


def test_training_verdict():
    schema = {"missing_in_b": ["target"], "type_mismatches": []}
    assert training_verdict(schema, [])["verdict"] == "REVIEW"
    assert training_verdict({"missing_in_b": ["age"], "type_mismatches": []}, [])["verdict"] == "FAIL"


@pytest.fixture
def contract(tmp_path):
    return write(tmp_path / "c.csv", pd.DataFrame({"id": [1, 2, 3, 4, 5], "status": ["a", "b", "a", "b", "a"], "age": [20, 30, 40, 50, 105], "email": ["a@b.c", "d@e.f", "bad-email", "g@h.i", "j@k.l"], "score": [1.0, None, 2.0, 3.0, 4.0]}))


def test_validate(spark, contract):
    ok = pr.validate(contract, {"id": {"is_unique": True, "min": 1}, "status": {"allowed_values": ["a", "b"]}, "age": {"max": 110}, "score": {"max_null_pct": 20}})
    assert ok.passed and ok.total_rules == ok.passed_rules == 5
    bad = pr.validate(contract, {"age": {"max": 100}, "email": {"regex": r"[^@]+@.+"}, "score": {"max_null_pct": 0}, "id": {"is_unique": True}})
    assert bad.failed and bad.failed_rules == 3 and {b.severity for b in bad.all_breaches()} == {"CRITICAL", "WARNING"}
    none = pr.validate(contract, {"ghost": {"min": 1, "max": 2}})
    assert none.failed and none.failed_rules == 2
    assert pr.validate(contract, {"email": {"regex": "("}}).failed
    by_profile = pr.validate(None, {"status": {"allowed_values": ["a"]}}, profile=pr.scan(contract))
    assert by_profile.failed
    with pytest.raises(SystemExit):
        pr.validate(contract, {"age": {"max": 100}}, fail_on_error=True)


def test_merge(spark, tmp_path, capsys):
    a = write(tmp_path / "a.csv", pd.DataFrame({"id": [1, 2], "v1": [10, 20]}))
    b = write(tmp_path / "b.csv", pd.DataFrame({"id": [3, 4], "v2": [30, 40]}))
    empty = tmp_path / "e.csv"
    empty.write_text("")
    out = str(tmp_path / "m.csv")
    df = pr.merge([a, b, str(empty)], out)
    assert df.count() == 4 and {"v1", "v2", "prismata_source_file"} <= set(df.columns)
    assert len(pd.read_csv(out)) == 4 and "skipped" in capsys.readouterr().out
    again = pr.merge([a, a], str(tmp_path / "n.csv"))
    assert again.count() == 2
    with pytest.raises(pr.PrismataError):
        pr.merge([a])


def test_merge_reports_shift_but_not_ids(spark, capsys):
    x = spark.range(50).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS val", "'f' AS flag")
    y = spark.range(50, 100).selectExpr("id", "CAST(id % 7 AS DOUBLE) * 3 AS val", "'f' AS flag")
    pr.merge([x, y], None)
    out = capsys.readouterr().out
    assert "val: mean" in out and "id: mean" not in out


def test_ask(spark, tmp_path):
    f = pd.DataFrame({"Pclass": [1, 2, 3] * 40, "Fare": [30.0, 20.0, 10.0] * 40, "Cabin": [None] * 90 + ["c"] * 30, "Survived": [0, 1] * 60, "fixed": [7] * 120})
    path = write(tmp_path / "t.csv", f)
    data = resolve(path)
    p = profile_dataset(data)
    q = lambda s: str(answer(p, s, data) or NOT_CONFIGURED)
    assert "120 rows" in pr.ask(path, "how many rows?", print_output=False) and "configured" in pr.ask(path, "hello there", print_output=False)
    assert "Cabin" in q("which columns have more than 50% nulls?")
    assert "Yes" in q("is this dataset good for classification?") or "No" in q("is this dataset good for classification?")
    assert "3 groups" in q("average Fare by Pclass") and q("average Fare by Pclass").index("1: 30") < q("average Fare by Pclass").index("3: 10")
    assert "20" in q("mean of Fare") and "not found" in q("mean of nothing at all")
    assert "120 rows" in q("how many rows?") and "5 columns" in q("how many columns are there?")
    assert "Survived" in q("any binary column?") and "fixed" in q("constant columns?")
    assert "/100" in q("data quality?") and "fixed" in q("what should i drop?")
    assert "configured" in q("hello there") and "Error" in pr.ask("/etc/passwd", "how many rows?", print_output=False)
    assert answer_offline(p, "how many rows?") == "120 rows." and answer_offline(p, "hello") is None and p.column("Survived").zero_count == 60
    for s in ("most null column", "outlier columns", "id columns", "correlated columns", "skew", "string columns", "numeric columns", "high cardinality", "was this sampled", "scan time"):
        assert "configured" not in q(s), s


def test_ml_ready(spark, tmp_path, capsys):
    f = pd.DataFrame({"id": range(60), "Survived": [0, 1] * 30, "age": [None if i % 5 == 0 else i % 9 for i in range(60)]})
    rows = {r.feature: r.verdict for r in pr.ml_ready(write(tmp_path / "t.csv", f)).collect()}
    assert rows == {"id": "DROP", "age": "KEEP"} and "target Survived" in capsys.readouterr().out


def test_report(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS `<script>alert(1)</script>`", "id % 4 AS category")
    text = open(pr.report(df, str(tmp_path / "r.html"))).read()
    assert "<script>" not in text and "http" not in text and "<svg" in text


def test_cli(spark, contract, tmp_path, capsys):
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"age": {"max": 100}}))
    assert main(["scan", contract, "--json"]) == 0 and json.loads(capsys.readouterr().out)["num_rows"] == 5
    assert main(["validate", contract, str(rules)]) == 1
    rules.write_text(json.dumps({"age": {"max": 200}}))
    assert main(["validate", contract, str(rules)]) == 0
    for args in (["version"], ["info", contract], ["run", contract, "--cols", "age"], ["profile", contract], ["warnings", contract, "--show-fixes"], ["ask", contract, "how many rows?"], ["fix", contract], ["ml-ready", contract], ["report", contract, "--output", str(tmp_path / "x.html")], ["compare", contract, contract], ["merge", contract, contract, "--output", str(tmp_path / "m.csv")]):
        assert main(args) == 0, args
    assert main(["scan", str(tmp_path / "none.csv")]) == 1
    assert os.path.exists(tmp_path / "x.html")


def test_pandas_input(spark):
    p = pr.scan(pd.DataFrame({"A": [1, 2, 3, 4, 5], "B": list("abcde"), "C": [1.0, 2, 3, 4, 5]}))
    assert (p.num_rows, p.num_cols, p.file_name) == (5, 3, "<DataFrame>")


def test_entry_imports():
    import __spark_entry__ as e

    assert "profile_numeric" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
