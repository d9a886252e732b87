import random
from itertools import combinations

import pytest

from prismata.operators.merge import merge, overlap, overlaps, union_keep_first
from prismata.session import PrismataError


def made(spark, rng, schema, rows):
    picks = {"int": [None, 0, 1, 2], "double": [None, 0.0, -0.0, 1.5, float("nan")], "string": [None, "", "a", "b"]}
    kinds = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame([tuple(rng.choice(picks[k]) for _, k in kinds) for _ in range(rows)], schema)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_those_of_each_pair(spark, seed):
    rng = random.Random(seed)
    schemas = ["a int, b string", "a int, b string, c double", "b string, a int", "c double, a int", "d string", "a double, b string"]
    frames = [made(spark, rng, s, n) for s, n in zip(schemas, (12, 40, 0, 30, 5, 20))]
    pairs, copies = overlaps(frames)
    assert pairs == {(i, j): overlap(frames[i], frames[j]) for i, j in combinations(range(6), 2)}
    assert copies == 0  # no column is in all


def test_copies_over_the_columns_of_all(spark):
    frames = [spark.createDataFrame(rows, "a int, b string") for rows in ([(1, "x"), (1, "x"), (None, None)], [(None, None), (2, "y")])]
    frames.append(spark.createDataFrame([("x", 1, 5), (None, 1, 5), ("x", None, 5)], "b string, a int, c int"))
    pairs, copies = overlaps(frames)
    assert copies == 3 and pairs == {(0, 1): 1, (0, 2): 1, (1, 2): 0}  # nulls in different columns differ
    assert overlaps(frames[:1]) == ({}, 0) and overlaps([]) == ({}, 0)


def test_more_frames_than_bits_of_a_word(spark):
    frames = [spark.createDataFrame([(i % 7,), (i % 7,), (100 + i,)], "a int") for i in range(70)]
    pairs, copies = overlaps(frames)
    assert pairs == {(i, j): int(i % 7 == j % 7) for i, j in combinations(range(70), 2)}
    assert copies == 70 * 2 - 7


def test_keep_first_by_columns(spark):
    a = spark.createDataFrame([(1, "late"), (1, "early"), (None, None)], "k int, v string")
    b = spark.createDataFrame([(1, 9.0), (2, 8.0), (None, 7.0)], "k int, `w.x` double")
    got = {tuple(r) for r in union_keep_first([("a", a), ("b", b)], "s", on=["k"]).collect()}
    assert got == {(1, "early", None, "a"), (None, None, None, "a"), (2, None, 8.0, "b")}
    with pytest.raises(PrismataError):
        union_keep_first([("a", a), ("b", b)], on=["v"])


def test_merge_tells_of_copies(spark, capsys):
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (2, "y")], [(1, "x"), (3, "z"), (3, "z")]))
    assert merge([a, b], output=None).count() == 3
    out = capsys.readouterr().out
    assert "1 equal rows in frame_0 and frame_1" in out and "2 rows repeat others" in out
    assert merge([a, b.select("k")], output=None, checks=False, on="common").count() == 3
