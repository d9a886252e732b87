import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from prismata.llm import decontaminate as D
from prismata.llm import jaccard_join as J
from prismata.llm import lang_id as LI
from prismata.llm import mixing as X
from prismata.llm import quality as Q
from prismata.llm import toxicity as T
from prismata.llm.common import BATCH_BYTES, WordHasher, ascii_lower, sample_by, space_bytes

SF = "/root/testdata/sf0.01"


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0, 7) for r in rows], "doc_id long, text string, lang string, source string, score double, n_shingles int")


# hashing ---------------------------------------------------------------


def test_word_hashes_are_those_of_words():
    rng = random.Random(0)
    texts = ["".join(rng.choices("aAbé \n\t", k=rng.randint(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    h, owner, first, last = WordHasher(space_bytes(), ascii_lower())(data, offs)
    want = [(i, w) for i, r in enumerate(raw) for w in r.lower().split()]
    assert [(i, data[a:b].tobytes().lower()) for i, a, b in zip(owner, first, last)] == want
    seen = {}
    for (_, w), x in zip(want, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# language --------------------------------------------------------------


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = LI.fit_filter(docs.where("doc_id % 3 <> 0"))
    held = docs.where("doc_id % 3 = 0")
    got = {r.doc_id: r for r in LI.identify(held, model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert np.mean([got[i].lang_pred == v for i, v in want.items()]) > 0.97
    odd = doc_frame(spark, [(1, None, "en"), (1, "", None), (None, "123 !!", "en"), (2, "İstanbul and the 言語 " * 3, None), (3, "the " * 100_000, "en")])
    r = LI.identify(odd, model).collect()
    assert [x.lang_pred for x in r[:3]] == ["und"] * 3 and r[0].score == 0 and r[4].lang_pred == "en" and all(0 <= x.score <= 1 for x in r)
    assert LI.identify(odd.where("false"), model).count() == 0
    assert LI.identify(odd, LI.fit_filter(odd.where("false"))).first().lang_pred == "und"


def test_language_query_against_exact_sets(spark):
    """The query on the whole table, and the same decision by exact sets of n-grams instead of filters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}

    def grams(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        return [g for w in words for p in [f" {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]

    counts = {}
    for r in {(r.doc_id, r.text): r for r in docs}.values():
        if not held[r.doc_id] and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for c in rates.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    sets = {lang: {g for g, x in rates[lang].items() if x >= LI.SHARE * most[g] and c[g] >= LI.LEAST_COUNT} for lang, c in counts.items()}
    got = LI.op2_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == held[r.doc_id] for r in got)
    text, lang, same, right = {r.doc_id: r.text for r in docs}, {r.doc_id: r.lang for r in docs}, 0, 0
    for r in got:
        own = grams(text[r.doc_id])
        same += r.lang_pred == ("und" if not own else max(sorted(sets), key=lambda k: sum(g in sets[k] for g in own)))
        right += r.lang_pred == lang[r.doc_id]
    assert same >= 0.995 * len(got) and right >= 0.97 * len(got)


def test_rare_languages_are_learned(spark):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))
    rows = [(i, make("abcdef"), "common") for i in range(2000)] + [(5000 + i, make("uvwxyz"), "rare") for i in range(20)]
    model = LI.fit_filter(doc_frame(spark, rows).select("doc_id", "text", "lang"), train_rows=40)
    assert model.languages == ["common", "rare"]
    got = LI.identify(doc_frame(spark, rows[-5:]).select("doc_id", "text"), model).collect()
    assert [r.lang_pred for r in got] == ["rare"] * 5


def test_repeated_ids_are_learned(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))
    rows = [(1, make("abcdef"), "a") for i in range(800)] + [(1, make("uvwxyz"), "b") for i in range(800)] + [(2, "same text of c", "c")] * 50
    model = LI.fit_filter(doc_frame(spark, rows).select("doc_id", "text", "lang"), train_rows=100)
    assert model.languages == ["a", "b", "c"]


def test_bit_slices_hold_all_members():
    rng = np.random.default_rng(0)
    sets = {f"l{i:02}": rng.integers(0, 1 << 62, 500).astype(np.uint64) for i in range(70)}
    f = LI.BitSlicedFilter.build(sets)
    for i, lang in enumerate(f.languages):
        assert ((f.masks(sets[lang])[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = f.masks(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    assert ((other[:, 0] & np.uint64(1)).mean() - f.chance[0]) < 0.01


def test_grams_are_of_words():
    g, owner = LI.grams(["ab, c", "", "c"], LI.letter_table())
    assert owner.tolist() == [0, 0, 0, 2] and g[2] == g[3]


# mixing ----------------------------------------------------------------


def test_targets_share_all():
    assert X.targets([100, 100, 100]) == pytest.approx([300 * 5 / 8, 300 * 2 / 8, 300 / 8])
    t = X.targets([10, 1000, 1000])
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    assert X.targets([]) == [] and X.targets([0, 5]) == [0, 5]


def test_tree_splits_exactly():
    rng = np.random.Generator(np.random.PCG64(1))
    out = X.split_quotas([100, 7, 0, 1], 13, rng)
    assert out.sum(0).tolist() == [100, 7, 0, 1] and out.sum(1).max() - out.sum(1).min() <= 3


def test_tree_is_hypergeometric():
    quotas, shards = [60, 30, 10], 5
    plain, tree = [], []
    for seed in range(400):
        rng = np.random.Generator(np.random.PCG64(seed))
        tree.append(X.split_quotas(quotas, shards, rng))
        order = rng.permutation(np.repeat(np.arange(3), quotas))  # the definition: a shuffle of all draws, cut into runs
        plain.append([np.bincount(run, minlength=3) for run in np.split(order, shards)])
    tree, plain = np.array(tree), np.array(plain)
    assert np.allclose(tree.mean(0), plain.mean(0), atol=0.6) and np.allclose(tree.var(0), plain.var(0), rtol=0.4, atol=0.3)
    assert (tree.sum(2) == 20).all() and (tree.sum(1) == quotas).all()


@pytest.mark.parametrize("below", [1, 7])
def test_subtrees_split_each_upper_shard(below):
    quotas = np.array([1000, 300, 0])
    ends = X.split_quotas(quotas.tolist(), 4, np.random.Generator(np.random.PCG64(5))).cumsum(0).T.copy()
    got = np.array([np.bincount(X.Shards(ends, below, 5).of(g, np.arange(n)), minlength=4 * below) for g, n in enumerate(quotas)])
    assert got.sum(1).tolist() == quotas.tolist() and np.ptp(got.sum(0)) <= 3
    assert (got.reshape(3, 4, below).sum(2).cumsum(1) == ends).all()
    again = X.Shards(ends, below, 5).of(0, np.random.Generator(np.random.PCG64(1)).permutation(1000))
    assert np.bincount(again, minlength=4 * below).tolist() == got[0].tolist()


def test_mix_query_against_plain_figures(spark):
    got = X.op4_mix_sources(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {i: len(r.text.encode().split()) for i, r in docs.items()}
    names = sorted({r.source for r in docs.values()})
    whole = {n: sum(sizes[i] for i, r in docs.items() if r.source == n) for n in names}
    unit, full = 0.0, set()
    weight = dict(zip(names, (5, 2, 1) * len(names)))
    while True:  # raise the unit until no more sources are full
        unit = (sum(whole.values()) - sum(3 * whole[n] for n in full)) / sum(w for n, w in weight.items() if n not in full)
        more = {n for n in names if unit * weight[n] > 3 * whole[n]}
        if more <= full:
            break
        full |= more
    taken = dict.fromkeys(names, 0)
    for r in got:
        n = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], whole[n]) and r.target == pytest.approx(min(3 * whole[n], unit * weight[n]))
        assert r.taken == r.size * len(r.draws) <= 3 * r.size and len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[n] += r.taken
        target = r.target
    assert all(abs(taken[n] - min(3 * whole[n], unit * weight[n])) < 0.02 * whole[n] + 5 for n in names) and target > 0
    rows = X.shuffled(X.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    places = {(r.doc_id, d["shard"], d["pass"], d["place"]) for r in got for d in r.draws}
    assert len(rows) == len(places) and {(r.doc_id, r.shard, r["pass"], r.position) for r in rows} == places


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = X.mix_sources(docs).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in X.mix_sources(docs).collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    taken, target, size = {}, {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) and len(r.draws) <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.draws)
        size[r.source] = size.get(r.source, 0) + r.size
        target[r.source] = r.target
    names = sorted(size)
    assert [target[n] for n in names] == pytest.approx(X.targets([size[n] for n in names]))
    assert all(abs(taken[n] - target[n]) < 0.02 * target[n] + 5 for n in names)
    out = X.shuffled(X.mix_sources(docs)).collect()
    assert len(out) == sum(len(r.draws) for r in rows)


def test_many_sources_reach_their_targets(spark, monkeypatch):
    monkeypatch.setattr(X, "PLAN_ROWS", 50)  # as with very many sources
    monkeypatch.setattr(X, "GROUP_ROWS", 500)
    monkeypatch.setattr(X, "SHARDS", 4)
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('site', id % 60) AS source", "repeat('w ', int(5 + id % 7)) AS text")
    rows = X.mix_sources(df).collect()
    taken, target, size = {}, {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.draws)
        size[r.source], target[r.source] = r.source_size, r.target
    names = sorted(size)
    assert [target[n] for n in names] == pytest.approx(X.targets([size[n] for n in names]))
    assert all(abs(taken[n] - target[n]) <= 12 for n in names)
    shards = np.bincount([d["shard"] for r in X.mix_sources(df).collect() for d in r.draws], minlength=16)
    assert len(shards) == 16 and shards.min() > 0.7 * shards.mean()
    assert [r.draws for r in X.mix_sources(df.limit(3).withColumn("text", F.lit(None))).collect()] == [[]] * 3


def test_mix_edges(spark):
    rows = [(1, None, None), (1, "a b", "x"), (None, "a", "x"), (None, "a", "x"), (2, "", "x")]
    df = spark.createDataFrame([(i, t, "en", s, 9) for (i, t, _), s in zip(rows, [None, "s", "s", None, "é"])], "doc_id long, text string, lang string, source string, size int")
    got = X.mix_sources(df).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 4 and {r.source_size for r in got if r.source == "s"} == {3}
    assert X.mix_sources(df.where("false")).count() == 0


# n-gram Jaccard join ---------------------------------------------------


def brute_join(rows):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("small_rows", [1_000_000, 0])
def test_join_equals_brute_force(spark, monkeypatch, small_rows):
    monkeypatch.setattr(J, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(J, "FREQUENT", 6)
    monkeypatch.setattr(J, "BLOCK", 10)
    monkeypatch.setattr(J, "PACK", 500)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 8, 30, 60, 120])) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "one two three four five"), (6, "one two three four five six")]
    while len(rows) < 260:
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1, 2])] = rng.choices(vocabulary, k=rng.choice([0, 1, 1]))
        rows.append((len(rows), " ".join(["common line that many have"] * (rng.random() < 0.3) + w)))
    df = doc_frame(spark, [(i, t, None) for i, t in rows]).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df).collect()}
    assert got == brute_join(rows)


def test_entries_of_a_set_do_not_grow_with_its_group(spark):
    def entries(copies):
        own = [(copies * 300, t) for t in range(400)]
        sets = spark.createDataFrame([(i, 500, own) for i in range(3)], "node long, n long, own array<struct<df: long, token: long>>")
        return J.index_entries(sets, 80).groupBy("node").count().first()[1]

    assert entries(1) == entries(5) < 500


def test_roots():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    want = {int(x): int(x) for x in np.r_[a, b]}
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist()):
            want[x] = want[y] = min(want[x], want[y])
    node, root = J.roots(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == want


def test_join_edges(spark):
    df = doc_frame(spark, [(None, "a b c d e f g h", None), (7, "a b c d e f g h", None), (7, "a b c d e f g h", None), (9, "z " * 50_000, None), (8, None, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (9, 1, 9), (8, 0, 8)], key=str)
    assert J.jaccard_join(df.where("false")).count() == 0


def test_blocks_follow_the_words_and_fill_the_shards(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_WORDS", 5)
    names = F.when(F.col("id") % 10 < 3, "a").when(F.col("id") % 10 < 6, "b")  # two sources and null
    df = spark.range(240_000).select(F.col("id").alias("doc_id"), names.alias("source"), F.lit("five words of a text").alias("text"))
    got = X.mix_sources(df, shards=100_000)
    per = got.select("source", "target", "size", F.col("draws")).withColumn("times", F.size("draws"))
    totals = per.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.max("target").alias("target"), F.max("times").alias("most")).collect()
    assert len(totals) == 3 and all(abs(r.taken - r.target) < 0.01 * r.target and r.most <= 3 for r in totals)
    assert got.select(F.explode("draws.shard")).distinct().count() >= 95_000
    twice = got.where(F.size("draws") > F.size(F.array_distinct("draws.pass")))
    assert twice.count() == 0


def test_more_draws_than_the_generator_takes():
    rng = np.random.Generator(np.random.PCG64(3))
    quotas = [1_500_000_000, 600_000_001, 3, 0]
    out = X.split_quotas(quotas, 5, rng)
    assert out.sum(0).tolist() == quotas and (out >= 0).all() and np.ptp(out.sum(1)) <= 2
    assert all(abs(r[0] - 300_000_000) < 200_000 for r in out)


# decontamination -------------------------------------------------------


def plain_align(a, b):
    best, h = 0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 25))
        score, start, end = D.align(a, b)
        assert score == plain_align(a.tolist(), b.tolist()) and 0 <= start <= end <= len(b)


def test_edited_copies_are_found(spark):
    rng = random.Random(4)
    words = [f"t{i}x" for i in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(12, 60)))) for k in range(20)] + [(20, None), (21, ""), (22, "single"), (None, items_text := " ".join(rng.choices(words, k=20)))]
    docs, want = [], set()
    for i in range(120):
        w = rng.choices(words, k=rng.randint(50, 300))
        if i % 3 == 0:
            k = rng.randrange(20)
            copy = items[k][1].split()
            for at in rng.sample(range(len(copy)), len(copy) // 8):
                copy[at] = rng.choice([copy[at].upper() + "!", rng.choice(words), ""])
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(w), None))
    docs += [(200, None, None), (201, "", None), (None, items_text, None)]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")
    for block in (1 << 24, 300):
        got = {(r.doc_id, r.item_id) for r in D.find_copies(doc_frame(spark, docs), bench, block_bytes=block).collect()}
        assert want <= got and got - want == {(None, None)}
    assert D.find_copies(doc_frame(spark, docs), bench.where("false")).count() == 0
    assert D.find_copies(doc_frame(spark, docs).where("false"), bench).count() == 0


def test_edited_copies_of_a_widely_leaked_item(spark):
    rng = random.Random(5)
    words = [f"t{i}x" for i in range(2000)]
    items = [" ".join(rng.choices(words, k=n)) for n in (18, 40, 13)]
    docs = []
    for i in range(300):
        w = rng.choices(words, k=rng.randint(5, 80))
        if i % 3 == 0:
            copy = items[i // 3 % 3].split()
            for at in rng.sample(range(len(copy)), round(len(copy) * rng.choice([0.12, 0.2, 0.25, 0.3]))):
                copy[at] = rng.choice(words)
            if i % 4 == 0:
                copy = copy[: len(copy) // 2]
            elif i % 5 == 0:
                copy = [y for k, x in enumerate(items[i // 3 % 3].split()) for y in ([x, "more"] if k % 2 and k < 14 else [x])]
            at = rng.randrange(len(w))
            w[at:at] = copy
        docs.append((i, " ".join(w), None))
    want = {(i, k) for i, text, _ in docs for k, item in enumerate(items) if plain_align(item.split(), text.split()) >= D.THRESHOLD * len(item.split())}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(want) > 60 and {(r.doc_id, r.item_id) for r in D.find_copies(doc_frame(spark, docs), bench).collect()} == want


def test_items_of_all_lengths_equal_plain_alignment_of_all_pairs(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    pool = common * 6 + [f"t{i}x" for i in range(400)]
    items = [" ".join(rng.choices(pool, k=n)) for n in [*range(1, 16), 1, 2, 3, 11, 11, 20, 35, 60]]
    docs = []
    for i in range(150):
        w = rng.choices(pool, k=rng.randint(0, 60))
        for item in rng.sample(items, 2):
            copy = item.split()
            for at in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 3)):
                copy[at] = rng.choice([rng.choice(pool), "", f"{copy[at]} more"])
            at = rng.randint(0, len(w))
            w[at:at] = copy
        docs.append((i, " ".join(w), None))
    eleven = [f"e{i}" for i in range(11)]
    items.append(" ".join(eleven))
    docs.append((900, " ".join("changed" if i in (2, 5, 8) else x for i, x in enumerate(eleven)), None))
    docs.append((901, docs[0][1], None))
    want = {}
    for i, text, _ in docs:
        for k, item in enumerate(items):
            n = len(item.split())
            score = plain_align(item.split(), text.split())
            if score >= D.THRESHOLD * n and score >= min(n, D.LEAST_WORDS):
                want[i, k] = score / n
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.find_copies(doc_frame(spark, docs), bench).collect()}
    assert (900, len(items) - 1) in want and len({k for _, k in want}) == len(items)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_whole_tables_equal_plain_alignment_of_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    tokens = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(x, len(number)) for x in tokens(t or "")], np.int64)
    texts, items = [coded(r.text) for r in docs], [coded(r.text) for r in bench]
    joined = np.concatenate([np.r_[t, -1 - np.arange(200)] for t in texts])  # no alignment gains by crossing so many words of no item
    owner = np.repeat(np.arange(len(texts)), [len(t) + 200 for t in texts])
    want = {}
    for r, item in zip(bench, items):
        if not len(item):
            continue
        row = np.zeros(len(joined) + 1)
        top, steps = np.zeros(len(texts)), np.arange(len(row))
        for word in item:
            row = np.maximum(np.r_[0, np.maximum(row[:-1] + np.where(joined == word, 1, -1), row[1:] - 1)], 0)
            row = np.maximum.accumulate(row + steps) - steps
            np.maximum.at(top, owner, row[1:])
        for t in np.flatnonzero(top >= np.maximum(D.THRESHOLD * len(item), min(len(item), D.LEAST_WORDS)) - 1e-9).tolist():
            want[docs[t].doc_id, r.item_id] = top[t] / len(item)
    got = {(r.doc_id, r.item_id): r.score for r in D.op1_decontamination(spark, sf).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_a_text_that_repeats_words_of_many_items_takes_bounded_memory():
    rng = random.Random(9)
    items = D.Items(list(range(20001)), [f"of the {' '.join(f'w{rng.randrange(10**6)}' for _ in range(10))}" for _ in range(20000)] + ["of the x of the x of the y"])
    make = D.hasher()
    raw = np.frombuffer(b"of the x " * 300000, np.uint8)
    words, owner, _, _ = make(raw, np.array([0, len(raw)]))
    tracemalloc.start()
    found = D.copies_in(items, words, owner, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[1] for f in found] == [20000] and abs(found[0][2] - 8 / 9) < 1e-9 and peak < 200 << 20


# quality ---------------------------------------------------------------


def plain_kneser_ney(texts):
    """Probability of a symbol after others, by the definition: a function of the n-gram as a string."""
    fold = lambda t: re.sub(r"[\t-\r]", " ", re.sub(r"[0-9]", "0", t))
    levels = {Q.ORDER: Counter(p[i - Q.ORDER + 1 : i + 1] for t in texts for p in ["\0" * (Q.ORDER - 1) + fold(t)] for i in range(Q.ORDER - 1, len(p)))}
    for k in range(Q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, counts in levels.items():
        n = [max(1, sum(v == i for v in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts[k] = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]

    def prob(gram):
        if not gram:
            return 1 / (len(levels[1]) + 1)
        counts, cut = levels[len(gram)], lambda v: cuts[len(gram)][min(v, 3) - 1]
        own = {x: v for x, v in counts.items() if x[:-1] == gram[:-1]}
        lower = prob(gram[1:])
        if not own:
            return lower
        total = sum(own.values())
        return (own[gram] - cut(own[gram]) if gram in own else 0) / total + sum(map(cut, own.values())) / total * lower

    return lambda t: [prob(p[i - Q.ORDER + 1 : i + 1]) for p in ["\0" * (Q.ORDER - 1) + fold(t)] for i in range(Q.ORDER - 1, len(p))]


@pytest.mark.parametrize("pack_bytes", [1 << 24, 50])
def test_perplexity_equals_definition(spark, monkeypatch, pack_bytes):
    monkeypatch.setattr(Q, "PACK_BYTES", pack_bytes)
    monkeypatch.setattr(Q, "CHUNK", 60)
    monkeypatch.setattr(Q, "SHARD_ROWS", 20)
    texts = ["The cat sat, 12 times.", "A cat and the HAT é ñ!", "the the the", "Кот сидел на окне", "кот и\tшляпа 7", "猫が座った。猫", "a", "zebra \0 zero"]
    docs = doc_frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(90, None, "en"), (91, "", None), (92, "Q unseen ☃", "en"), (92, "the cat", "xx")]).repartition(3)
    docs = docs.cache()
    folds = {r.text: r.fold for r in Q.with_fold(docs).collect()}
    plain = [plain_kneser_ney([t for t in texts if folds[t] != f]) for f in (0, 1)]
    model, unknown = Q.train_model(docs.where("doc_id < 90"))
    got = Q.score_documents(docs, model, unknown, carry=["text", "n_shingles"]).collect()
    assert len(got) == len(texts) + 4 and {r.carried.n_shingles for r in got} == {7}
    for r in got:
        want = plain[folds[r.carried.text]](r.carried.text or "")
        assert r.n_symbols == len(want) and r.nll == pytest.approx(-sum(map(math.log, want)), rel=1e-4, abs=1e-6)


def test_slots():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(1, 1 << 40, 5000).astype(np.uint64) << np.uint64(20))
    slots = Q.Slots(16)
    for part in np.array_split(rng.permutation(keys), 7):
        slots.add(part)
    assert sorted(slots.find(keys).tolist()) == list(range(len(keys))) and (slots.find(keys + np.uint64(1)) == -1).all()


def test_quality_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.keep for r in Q.judge_quality(docs, Q.trusted_ids(labels)).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([got[i] for i, q in marks.items() if q == 1]) > 0.98
    assert np.mean([got[i] for i, q in marks.items() if q == 0]) < 0.2


def test_quality_query_against_plain_figures(spark):
    """Means, ranges and decisions of the query, from its perplexities, without Spark."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    got = Q.op8_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = {}
    for r in got:
        assert r.n_symbols == len(docs[r.doc_id].text or "") and r.lang == docs[r.doc_id].lang
        if r.n_symbols:
            by.setdefault(r.lang, []).append((r, math.log(r.perplexity)))
    for rows in by.values():
        good = [(r, x) for r, x in rows if r.doc_id in trusted]
        mean = sum(x * r.n_symbols for r, x in good) / sum(r.n_symbols for r, _ in good)
        own = sorted((x - mean) * math.sqrt(r.n_symbols) for r, x in good)
        at = lambda q: own[max(0, math.ceil(q * len(own)) - 1)]
        low = at(0.5) - Q.SLACK * max(at(0.5) - at(Q.LOW), Q.REACH * (at(0.5) - at(0.25)))
        high = at(0.5) + Q.SLACK * max(at(Q.HIGH) - at(0.5), Q.REACH * (at(0.75) - at(0.5)))
        for r, x in rows:
            d = (x - mean) * math.sqrt(r.n_symbols)
            assert r.deviation == pytest.approx(d, abs=1e-6) and (r.low, r.high) == pytest.approx((low, high), abs=1e-6)
            assert r.keep == (low <= d <= high) or min(abs(d - low), abs(d - high)) < 1e-6


def test_quality_passes_hold_little_of_a_pack():
    """A whole pack is scored in a few times its size, and no text's figures depend on the passes."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 3000)]
    texts, sizes = [], []
    while sum(sizes) < Q.PACK_BYTES:
        texts.append(" ".join(words[i] for i in rng.integers(0, 3000, 500)).encode())
        sizes.append(len(texts[-1]))
    s, _ = Q.symbols([t.decode() for t in texts[:50]])
    keys = np.unique(np.concatenate([x[s > 0] for x in Q.gram_keys(s, 0)]))
    logp, weight = (np.linspace(-3, -1, len(keys), dtype=np.float32) for _ in "12")
    packed = zstandard.compress(b"".join(texts), 3)
    tracemalloc.start()
    n, nll = Q.score_texts(0, np.array(sizes), packed, keys, logp, weight, -9.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for i in (0, len(texts) // 2, len(texts) - 1):
        one = Q.score_texts(0, np.array(sizes[i : i + 1]), zstandard.compress(texts[i], 3), keys, logp, weight, -9.0)
        assert n[i] == one[0][0] == len(texts[i]) and nll[i] == pytest.approx(one[1][0])


def test_quality_replies_come_in_small_batches():
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(1, 1 << 62, 60_000).astype(np.uint64))
    logp, weight = rng.random(len(known), dtype=np.float32), rng.random(len(known), dtype=np.float32)
    rows = pa.table({"key": known.view(np.int64), "logp": logp, "weight": pa.array(weight)})
    asked = [np.r_[known[i::3], rng.integers(1 << 62, 1 << 63, 5).astype(np.uint64)] for i in range(3)] * 10 + [np.zeros(0, np.uint64)]
    own = pa.table({"pack": range(31), "check": range(100, 131), "keys": pa.array([x.tobytes() for x in asked], pa.binary())})
    out = Q.look_up(own, rows)
    sizes = [b.nbytes for b in out.to_batches()]
    assert len(sizes) > 5 and max(sizes) <= BATCH_BYTES + (1 << 19)
    assert out["pack"].to_pylist() == list(range(31)) and out["check"].to_pylist() == list(range(100, 131))
    for i, r in enumerate(out.to_pylist()[:30]):
        assert r["keys"] == known[i % 3 :: 3].tobytes() and r["logp"] == logp[i % 3 :: 3].tobytes() and r["weight"] == weight[i % 3 :: 3].tobytes()
    assert out["keys"][30].as_py() == b"" and Q.look_up(own.slice(0, 0), rows).num_rows == 0
    assert Q.look_up(own, rows.slice(0, 0))["keys"].to_pylist() == [b""] * 31


def test_quality_edges(spark):
    df = doc_frame(spark, [(1, None, "en"), (1, "", None), (None, "the cat sat", "xx"), (2, "the cat sat on the mat " * 3000, "en"), (3, "the cat", "en")])
    trusted = spark.createDataFrame([(2,), (3,)], "doc_id long")
    got = Q.judge_quality(df, trusted).collect()
    assert len(got) == 5 and [r.perplexity for r in got if r.n_symbols == 0] == [None, None] and all(r.keep is not None for r in got)
    assert all(r.keep for r in Q.judge_quality(df, trusted.where("false")).collect())
    assert Q.judge_quality(df.where("false"), trusted).count() == 0


# toxicity --------------------------------------------------------------


def test_pooling_equals_plain():
    net = T.ConvNet.start()
    net.table[:] = np.random.default_rng(0).standard_normal(net.table.shape)
    raw = [b"one two three", b"", b"solo", b"a b c d e f g"]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    feats, owner = T.Features()(data, offs)
    pooled = net.pool(feats, owner, 4)[0]
    for t in range(4):
        x = net.vectors(feats[owner == t])
        for i, w in enumerate(net.filters):
            width = T.WIDTHS[i]
            acts = [np.maximum(x[j : j + width].ravel() @ w, 0) for j in range(len(x) - width + 1)]
            assert np.allclose(pooled[t, i * T.FILTERS : (i + 1) * T.FILTERS], np.max(acts, 0) if acts else 0, atol=1e-4)


def test_best_cut():
    cut = T.best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1]))
    assert 0.2 < cut < 0.8


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit_toxicity(docs, labels.where(T.residue("doc_id", 4) != 2))
    held = labels.where(T.residue("doc_id", 4) == 2).join(docs, "doc_id")
    want = {r.doc_id: (r.toxic, r.lang, len(r.text) > 8 * T.TRAIN_WORDS) for r in held.collect()}
    got = {r.doc_id: r for r in T.score_toxicity(held.select("doc_id", "text", "lang"), model).collect()}
    y, lang, long = (np.array([want[i][k] for i in got]) for k in range(3))
    for p in (np.array([r.score >= T.THRESHOLD for r in got.values()]), np.array([r.toxic for r in got.values()])):
        assert p[y == 1].mean() >= 0.9 and y[p].mean() >= 0.8
        for one in ("en", "de", "fr", "es"):
            own = lang == one
            assert p[own & (y == 1)].mean() >= 0.9 and p[own & (y == 0)].mean() < 0.1
        assert p[long & (y == 0)].mean() < 0.2


def test_toxicity_sample_is_bounded_whatever_repeats(spark):
    rows = spark.range(4000).selectExpr("5L AS doc_id", "concat('word', id % 1000) AS text", "'en' AS lang").unionByName(spark.range(300).selectExpr("id + 10 AS doc_id", "concat('w', id) AS text", "CAST(NULL AS STRING) AS lang"))
    kept = sample_by(rows, "lang", 100, "x").collect()
    assert 60 < len(kept) < 140 and len({(r.doc_id, r.text) for r in kept}) == len(kept) and 25 < sum(r.lang is None for r in kept) < 75
    assert sample_by(rows, "lang", 10_000, "x").count() == 1300 and sample_by(rows.where("false"), "lang", 10, "x").count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Insults that four of 18,400 labelled rows have each: a sample of the rows misses some."""
    rng = np.random.default_rng(3)
    plain = [" ".join(f"plain{x}" for x in rng.integers(0, 200, 8)) for _ in range(18_400)]
    toxic = [f"{t} insult{chr(97 + i % 10)}{chr(97 + i // 10)}" for t, i in zip(plain[:400], np.arange(400) % 100)]
    rows = [(i, t, "en") for i, t in enumerate(toxic + plain[400:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(len(rows))], "doc_id long, toxic int")
    monkeypatch.setattr(T, "PACK_BYTES", 1 << 20)
    asked = spark.createDataFrame([(i, f"plain1 plain2 {t.split()[-1]} plain3 plain4", "en") for i, t in enumerate(toxic[:100])], docs.schema)
    model = T.fit_toxicity(docs, labels)
    assert np.mean([r.toxic for r in T.score_toxicity(asked, model).collect()]) > 0.98
    assert np.mean([r.toxic for r in T.score_toxicity(docs.where("doc_id >= 400"), model).collect()]) < 0.02


def test_toxicity_packs_hold_whole_texts_and_thresholds_count_all():
    raw = [b"one two three one", b"", b"solo " * 5000]
    pack = T.Pack.load(T.Pack.of([(0, 0, raw[0]), (0, 1, raw[1]), (0, 0, raw[2])]).dump())
    assert sorted(len(pack.text(i)) for i in range(3)) == [0, 4, 5000]
    assert sum(len(owner) for _, _, owner in pack.passes(np.arange(3))) == 5004
    times = np.array([5, 1, 2, 9])
    s, y = np.array([0.1, 0.4, 0.3, 0.9]), np.array([0, 0, 1, 1])
    assert T.best_cut(s, y, times=times) == T.best_cut(np.repeat(s, times), np.repeat(y, times))


def test_batches_are_bounded_in_bytes(spark):
    from prismata.llm.common import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for given, want in (("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(key, given)
            small_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key)


def test_toxicity_query_against_plain_scores(spark):
    """The query's scores, from the definition: one text and one window at a time."""
    spark_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = T.unpack_model(T.labelled_model(spark, spark_docs, SF))
    net, table_ = model.net, model.net.table.astype(np.float32)
    docs = {r.doc_id: r for r in spark_docs.collect()}
    got = T.op9_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        assert r.toxic == (r.score >= T.THRESHOLD) and r.language in (None, *model.thresholds)
    assert np.mean([r.language == docs[r.doc_id].lang for r in got]) > 0.95
    cut = lambda p: math.log(p / (1 - p))
    for r in sorted(got, key=lambda r: len(docs[r.doc_id].text))[::40]:
        raw = docs[r.doc_id].text.encode()
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        feats = [T.Features()(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in words]
        x = [sum(table_[b] for b in f) for f in feats]
        z = net.offset + net.weights[-1] * math.log1p(len(words)) + (cut(T.THRESHOLD) - cut(model.thresholds[r.language]) if r.language else 0)
        for i, w in enumerate(net.filters):
            width = len(w) // T.DIM
            acts = [np.maximum(np.concatenate(x[k : k + width]) @ w + net.bias[i * T.FILTERS : (i + 1) * T.FILTERS], 0) for k in range(len(x) - width + 1)]
            z += float((np.max(acts, 0) if acts else np.zeros(T.FILTERS)) @ net.weights[i * T.FILTERS : (i + 1) * T.FILTERS])
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-3)


def test_toxicity_edges(spark):
    df = doc_frame(spark, [(1, None, "en"), (1, "", None), (None, "!!", "xx"), (2, "idiot " * 100_000, "en")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id long, toxic int")
    for lab in (labels, labels.where("false")):
        got = T.score_toxicity(df, T.fit_toxicity(df, lab)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score == got[2].score
    assert T.score_toxicity(df.where("false"), T.fit_toxicity(df, labels)).count() == 0
