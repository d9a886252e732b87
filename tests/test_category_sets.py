import math

from prismata.operators.drift import category_sets, compare


def frames(spark):
    a = spark.createDataFrame([(f"v{i % 500}", float(i % 3) if i % 7 else math.nan, None) for i in range(2_000)], "`a.b` string, x double, n string")
    b = spark.createDataFrame([(f"v{i % 600 + 300}" if i % 5 else None, None if i % 2 else math.inf, None) for i in range(3_000)], "`a.b` string, x double, n string")
    return a, b


def test_sets_equal_plain_sets(spark):
    a, b = frames(spark)
    columns = ["a.b", "x", "n"]
    one, two = ([{r[i] for r in rows if r[i] is not None and not (isinstance(r[i], float) and not math.isfinite(r[i]))} for i in range(3)] for rows in (a.collect(), b.collect()))
    want = [(c, len(x), len(y), len(y - x), len(x - y), len(x & y) / len(x | y) if x | y else None, 0) for c, x, y in zip(columns, one, two)]
    for exact in (True, False):
        assert [tuple(c.values()) for c in category_sets(a, b, columns, exact)] == want
    assert category_sets(a, b, []) == []
    empty = category_sets(a.where("false"), b, columns)
    assert [(c["unique_a"], c["n_missing"]) for c in empty] == [(0, 0)] * 3 and empty[0]["n_new"] == len(two[0])


def test_many_values_lie_within_the_margin(spark):
    a, b = spark.range(0, 300_000).selectExpr("cast(id as string) as v"), spark.range(200_000, 400_000).selectExpr("cast(id as string) as v")
    got = category_sets(a, b, ["v"])[0]
    assert 0 < got["margin"] < 0.03 * 400_000
    for c, n in (("unique_a", 300_000), ("unique_b", 200_000), ("n_new", 100_000), ("n_missing", 200_000)):
        assert abs(got[c] - n) <= got["margin"]
    assert category_sets(a, b, ["v"], exact=True)[0] | {"margin": 0} == {"col_name": "v", "unique_a": 300_000, "unique_b": 200_000, "n_new": 100_000, "n_missing": 200_000, "jaccard": 0.25, "margin": 0}


def test_compare_counts_values_beyond_the_list(spark, capsys):
    a, b = frames(spark)
    for exact in (True, False):
        found = [c for c in compare(a, b, exact_categories=exact).categories if c["overflowed"] and c["unique_a"]]
        assert [(c["col_name"], c["n_new"], c["n_missing"]) for c in found] == [("a.b", 320, 340)]
        assert "320 new" in capsys.readouterr().out
