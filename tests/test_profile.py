import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import prismata as pr
from prismata import queries as Q
from prismata.functions.columns import NULL_MARKERS, decide_type
from prismata.operators.issues import collect_warnings, ml_score, quality_label, quality_score, warnings_frame
from prismata.operators.profile import ColumnProfile, profile_dataset
from prismata.plans.passes import shape
from prismata.sources.readers import Dataset, spans_lines
from prismata.streaming import IncrementalProfile


def csv(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_basic_csv(spark, tmp_path):
    p = pr.scan(csv(tmp_path, "name,age,salary,city\na,22,1.5,x\nb,35,2.5,y\nc,26,,x\nd,30,3.5,z\ne,27,4.5,y\n"))
    age = p.column("age")
    assert (p.num_rows, p.num_cols, p.num_numeric, p.num_string) == (5, 4, 2, 2)
    assert (age.mean, age.val_min, age.val_max, age.type_str) == (28, 22, 35, "int")
    assert p.column("salary").null_pct == 20 and p.overall_null_pct == 5
    assert p.column("city").top_values == ["x", "y", "z"]


def test_builder_csv(spark, tmp_path):
    rows = ["name,age,salary,city,active"] + [f"n{i},{'' if i == 3 else 20 + i},{'' if i == 4 else 'NULL' if i == 5 else i * 1.5},c{i % 3},{'true' if i % 2 else 'false'}" for i in range(10)]
    p = pr.scan(csv(tmp_path, "\n".join(rows)))
    assert (p.num_numeric, p.num_string, p.total_null_cells, p.overall_null_pct) == (3, 2, 3, 6)


def test_moments():
    x = [2, 4, 4, 4, 5, 5, 7, 9]
    var, g1, g2 = shape(len(x), [0, *(sum((v - 5) ** k for v in x) for k in (1, 2, 3, 4))])
    assert var == pytest.approx(4.571, abs=1e-3) and g1 == pytest.approx(0.8185, abs=1e-4) and g2 == pytest.approx(0.9406, abs=1e-4)


def test_correlation_and_constant(spark):
    df = spark.createDataFrame([(i, -i, 1) for i in range(10)], "a int, b int, c int")
    p = pr.scan(df)
    assert [(c.col_a, c.col_b, round(c.r, 9), c.direction, c.strength) for c in p.correlations] == [("a", "b", -1, "negative", "very_strong")]
    assert p.column("c").is_constant and p.column("c").histogram_bins[0] == 10


def test_late_misfit_and_null_markers(spark, tmp_path):
    body = "".join(f"{i},{i}\n" for i in range(5010))
    p = pr.scan(csv(tmp_path, "id,val\n" + body + "5010,INVALID\n"))
    c = p.column("val")
    assert (c.type_str, c.null_count, c.type_mismatch_count) == ("int", 0, 1)
    p = pr.scan(csv(tmp_path, "a,b\n" + "".join(f"{m.upper()},1\n" for m in NULL_MARKERS) + "7,1\n", "u.csv"))
    assert p.column("a").null_count == len(NULL_MARKERS) and p.column("a").type_str == "int"


def test_booleans(spark, tmp_path):
    p = pr.scan(csv(tmp_path, "flag\n" + "\n".join(["true", "false", "yes", "no", "y", "n", "1", "0"])))
    assert p.column("flag").type_str == "bool" and p.column("flag").mean == 0.5
    p = pr.scan(csv(tmp_path, "flag\n" + "true\n" * 100 + "track\nfalse\n", "u.csv"))
    assert p.column("flag").type_str == "bool" and p.column("flag").type_mismatch_count == 1


def test_bom_quotes_ragged(spark, tmp_path):
    p = pr.scan(csv(tmp_path, '﻿ id ,note\n1,"two\nlines"\n2,"say ""hi"""\n3\n\n4,x,extra\n'))
    assert [c.name for c in p.columns] == ["id", "note"] and p.num_rows == 4 and p.column("note").null_count == 1


@pytest.mark.parametrize("body,want", [("a,b\n1,x\n2,y\n", False), ('a,b\n1,"x, ""y"""\n', False), ('a,b\n1,"x\ny"\n', True), ("a\n1\n  \n2\n", True), ('a,b\n1,x"\n', True)])
def test_only_fields_that_span_lines_keep_a_file_whole(spark, tmp_path, body, want):
    path = tmp_path / "t.csv"
    path.write_text(body)
    assert spans_lines(str(path)) is want


@pytest.mark.parametrize("counts,want", [((0, 0, 0, 0, 0), "unknown"), ((8, 0, 0, 0, 2), "bool"), ((0, 98, 0, 0, 2), "int"), ((0, 90, 0, 8, 2), "float"), ((0, 97, 0, 0, 3), "str"), ((3, 2, 2, 0, 0), "bool"), ((3, 5, 2, 0, 0), "int"), ((0, 3, 0, 1, 0), "float")])
def test_type_decision(counts, want):
    assert decide_type(*counts) == want


def test_parquet_and_nan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE id * 2.5D END AS value", "'c' || id % 4 AS category").write.parquet(path)
    c = pr.scan(path).column("value")
    assert (c.null_count, c.val_min, c.val_max) == (200, 2.5, 2497.5)
    c = pr.scan(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")).column("x")
    assert (c.null_count, c.val_max) == (3, 1.0)


def test_types(spark):
    df = spark.sql("SELECT DATE'2020-01-01' AS d, CAST(1.5 AS DECIMAL(5,2)) AS n, array(1) AS a, true AS b, map('k', 1) AS m, 'x' AS `odd.name`")
    p = pr.scan(df)
    assert [c.type_str for c in p.columns] == ["datetime", "float", "unknown", "bool", "unknown", "str"]
    assert p.column("a").null_count == 0 and p.column("d").val_min == 1577836800


def test_empty_and_wide(spark):
    p = pr.scan(spark.createDataFrame([], "a int, b string"))
    assert p.num_rows == 0 and p.overall_null_pct == 0 and p.column("a").is_constant
    wide = spark.range(5).selectExpr(*[f"id * {i} AS c{i}" for i in range(55)])
    assert pr.scan(wide).correlation_skipped and not pr.scan(wide, correlate=True).correlation_skipped


def test_sampling(spark):
    p = pr.scan(spark.range(10_000), sample_size=500)
    assert p.is_sampled and p.num_rows == 500
    assert not pr.scan(spark.range(100), sample_size=500).is_sampled


def test_sampled_parquet_has_exact_nulls_and_extremes(spark, tmp_path):
    path = str(tmp_path / "big.parquet")
    spark.range(20_000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS v").write.parquet(path)
    for _ in range(2):
        p = pr.scan(path, sample_size=1000)
        assert p.is_sampled and p.num_rows == 1000
        assert (p.column("id").val_min, p.column("id").val_max, p.column("v").null_pct, p.overall_null_pct) == (0, 19_999, 25, 12.5)


def test_exact_and_sketched_distinct(spark):
    df = spark.range(300_000).selectExpr("id", "id % 50 AS few", "CAST(id AS STRING) AS s")
    p = pr.scan(df)
    assert p.column("few").unique_exact == 50 and not p.column("id").exact_unique_valid
    assert abs(p.column("id").unique_approx / 300_000 - 1) < 0.05
    assert pr.scan(df, exact=True).column("s").unique_exact == 300_000


def test_counts_that_a_sketch_leaves_open_are_exact(spark, tmp_path):
    """120,000 values are just below the middle of a step (67.49 quarters of a doubling), and their sketch's estimate is above it."""
    columns = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = spark.range(120_000).selectExpr("id AS l_partkey", "concat('s', id) AS l_shipdate", *[f"id % {k + 99} AS {c}" for k, c in enumerate(columns)])
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["name"]: (r.few, r.magnitude) for r in Q.hll_distinct(spark, str(tmp_path)).collect()}
    assert got["l_partkey"] == got["l_shipdate"] == (None, 67)
    assert [got[c][0] for c in columns] == [99, 100, *[None] * 7]


def test_what_a_sketch_settles_is_not_counted(spark):
    p = profile_dataset(Dataset(spark.range(300_000), "t"), parts=["distinct"], settle=lambda n: n > 250_000)
    assert not p.column("id").exact_unique_valid
    p = profile_dataset(Dataset(spark.range(300_000), "t"), parts=["distinct"], settle=lambda n: n > 299_999)
    assert p.column("id").unique_exact == p.column("id").unique_approx == 300_000


@pytest.mark.parametrize("bad", ["nope.csv", "x\0.csv", "t.txt"])
def test_bad_paths(spark, tmp_path, bad):
    (tmp_path / "t.txt").write_text("a")
    with pytest.raises(pr.PrismataError):
        pr.scan(str(tmp_path / bad))


def test_path_guards(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("")
    binary = tmp_path / "b.csv"
    binary.write_bytes(b"a,b\n\0\1")
    inside = csv(tmp_path, "a\n1\n")
    for path, options in ((empty, {}), (binary, {}), (inside, {"allowed_dir": str(tmp_path / "other")})):
        with pytest.raises(pr.PrismataError):
            pr.scan(str(path), **options)
    with pytest.raises(pr.PrismataError):
        pr.scan(12)


def test_warnings_match_frame(spark):
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 10 < 7 THEN NULL ELSE 'v' END AS sparse", "'k' || id AS key", "1 AS one", "CASE WHEN id = 7 THEN 100000 ELSE id % 50 END AS spiky")
    p = pr.scan(df)
    found = [(w["column"], w["category"], w["severity"], w["action_type"]) for w in collect_warnings(p)]
    assert {tuple(r) for r in warnings_frame(p.columns_frame()).collect()} == set(found)
    assert [s for _, _, s, _ in found] == sorted((s for _, _, s, _ in found), key=["critical", "warning", "info"].index)
    assert ("spiky", "outlier", "info", "clip") in found and ("one", "constant", "info", "drop") in found


def test_hostile_name_stays_a_name(spark):
    name = "x'); import os #"
    p = pr.scan(spark.range(100).selectExpr(f"id AS `{name}`"))
    compile(collect_warnings(p)[0]["fix_code"], "fix", "exec")


def test_scores(spark):
    p = pr.scan(spark.createDataFrame([(i, i, None if i else 1.0) for i in range(5)], "good int, bad_id int, bad_nulls double"))
    p.columns, p.num_cols = p.columns[:1], 1
    p.overall_null_pct = 0.0
    assert quality_score(p, 3) == 90 and quality_label(90) == "GOOD" and ml_score(p) == 85


def test_json(spark):
    d = pr.scan(spark.range(10).selectExpr("id", "'x' AS s")).to_dict()
    assert d["num_rows"] == 10 and "mean" in d["columns"][0] and "mean_str_len" in d["columns"][1]


def test_incremental_equals_whole(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CAST(id * id AS DOUBLE) AS sq", "'g' || id % 7 AS g")
    inc = IncrementalProfile(str(tmp_path / "state"))
    for i in range(4):
        inc(df.where(f"id % 4 = {i}"), i)
    inc(df.where("id % 4 = 1"), 1)  # replayed
    got = {r["column"]: r for r in inc.columns(spark)}
    whole = pr.scan(df)
    for name in ("id", "sq"):
        w = whole.column(name)
        assert got[name]["total_count"] == 1000 and math.isclose(got[name]["variance"], w.variance, rel_tol=1e-9) and math.isclose(got[name]["kurtosis"], w.kurtosis, rel_tol=1e-6)
    assert got["g"]["unique_approx"] == 7


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).repartition(3).write.parquet(src)
    inc = IncrementalProfile(str(tmp_path / "state"))
    q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(inc).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert inc.columns(spark)[0]["total_count"] == 100


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab,"\n 1.', min_size=1, max_size=6), min_size=2, max_size=2), min_size=1, max_size=8))
def test_any_csv(spark, tmp_path, rows):
    import csv as module
    import io

    out = io.StringIO()
    module.writer(out, quoting=module.QUOTE_ALL, lineterminator="\n").writerows([["p", "q"], *rows])
    path = csv(tmp_path, out.getvalue(), "any.csv")
    p = pr.scan(path)
    assert (p.num_rows, [c.name for c in p.columns]) == (len(rows), ["p", "q"])


def test_column_profile_defaults():
    c = ColumnProfile("x", "int")
    assert c.unique_exact == -1 and not c.exact_unique_valid
