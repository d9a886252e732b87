import random
from collections import Counter

import pytest

import corpus_pipeline as P
from prismata.llm import jaccard_join as J
from prismata.llm.common import stash
from prismata.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_filter_as_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        after = stash(stage(spark, kept, SF), name)
        assert after.columns == COLUMNS and after.subtract(kept).isEmpty()
        assert kept.count() * 0.5 < after.count() <= kept.count()
        if name == "near_duplicates":
            found = {r.doc_id for r in J.jaccard_join(kept).collect() if r.doc_id == r.component_id}
            assert {r.doc_id for r in after.collect()} == found
        kept = after
    mix = P.mixing(spark, kept, SF)
    assert mix.columns == [*COLUMNS, "shard", "pass", "position"]
    assert mix.select("doc_id").distinct().join(kept, "doc_id", "left_anti").isEmpty()


def test_repeated_rows_count_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    twice = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars"))
    out = P.near_duplicates(spark, twice, SF)
    assert out.count() == P.near_duplicates(spark, docs, SF).count()


def test_near_copies_go_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = lambda k: text(k) + " end"
    rows = [(1, text(1)), (None, near(1)), (None, text(2)), (None, text(3)), (None, near(3)), (None, None), (None, "")]  # null ids: a copy, one of its own, two near copies, no words
    rows += [(5, text(5)), (6, near(5)), (6, text(6)), (7, text(7)), (7, near(7)), (8, text(8)), (8, text(9)), (9, text(8).upper()), (8, text(8)), (10, ""), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect()]
    sure = [(1, text(1)), (None, text(2)), (None, None), (None, ""), (5, text(5)), (6, text(6)), (8, text(8)), (8, text(9)), (10, ""), (11, "")]
    left = [x for x in out if x not in sure]
    assert len(out) == len(sure) + 2 and all(out.count(x) == 1 for x in sure)
    assert sorted(left, key=str) in [sorted([(None, a), (7, b)], key=str) for a in (text(3), near(3)) for b in (text(7), near(7))]


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of small tables, and documents with nulls, repeated ids and rows, ties, a very long text and clashing names."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices("the of and to in was that house river winter people small found over light".split(), k=n))
    texts = [prose(60) for _ in range(40)]
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "a"), (3, prose(50), "en", None), (None, prose(70), None, "c"), (None, None, "en", "c"), (None, "", None, None), (50, "   ", "xx", "a"), (51, prose(20_000), "en", "b")]
    rows += [(60, f"{prose(10)} {item} {prose(10)}", "en", "a"), (None, f"{item} {prose(12)}", "en", "a"), (61, texts[5] + " end", "en", "b"), (None, texts[6] + " end", "en", "b")]
    rows += [(70 + i, f"you stupid idiot clown {prose(20)} idiot", "en", "a") for i in range(8)]
    names = "doc_id long, text string, lang string, source string, n_chars int, id string, key long, lead int, gone_id int, carried string, shard_ int, block long, size double, toxic boolean"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2, 3, "y", 4, 5, 6.0, False) for r in rows], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(70 + i, 0, 1) for i in range(8)] + [(None, 1, 1), (99, None, None), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_of_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").cache()
    given = [tuple(r)[:5] for r in docs.collect()]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = [tuple(r)[:5] for r in out.collect()]
        assert not Counter(kept[name]) - Counter(given)
        assert stage(spark, docs.where("false"), odd).count() == 0
    gone = {name: [r for r in given if r not in kept[name]] for name in kept}
    assert all("idiot" in (r[1] or "") for r in gone["toxicity"]) and all(r[1] for r in gone["quality"])
    assert {r[0] for r in gone["decontamination"]} == {60, None} and len(gone["decontamination"]) == 2
    assert {61} <= {r[0] for r in gone["near_duplicates"]} and all(r[0] in (61, None) or r[0] >= 70 for r in gone["near_duplicates"])
    assert len(kept["near_duplicates"]) == len(given) - 3 and sum(r[0] == 3 for r in kept["near_duplicates"]) == 2
    mixed = P.mixing(spark, docs, odd)
    assert mixed.columns == [*docs.columns, "shard", "pass", "position"] and not {tuple(r)[:5] for r in mixed.collect()} - set(given)
    assert P.mixing(spark, docs.where("false"), odd).count() == 0


def test_run_equals_its_stages(spark, odd):
    out = [tuple(r) for r in P.run(spark, odd).collect()]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stash(stage(spark, docs, odd), name)
    assert sorted(out, key=str) == sorted(map(tuple, docs.collect()), key=str) and len(out) > 20


def test_names():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE_SQL) <= set(QUERIES)
