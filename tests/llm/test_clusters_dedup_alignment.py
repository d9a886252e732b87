import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.llm import centroids as C
from prismata.llm import token_alignment as T
from prismata.llm.exact_dedup import exact_dedup, op12_exact_dedup, without_copies
from prismata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# Clusters --------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, cluster string, x int, norms string"


def plain_clusters(rows, k, rounds, dims, scale=1024):
    exact = lambda v: int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale)
    kept = [(i, [exact(v) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept), key=repr), centroids


@pytest.mark.parametrize("top", [1.0, 1e6, 1e300])
def test_clusters_equal_plain_integers(spark, top):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * (top if i % 9 == 0 else 1.0) for _ in range(5)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (100, None), (101, [1.0]), (102, [None] * 5), (103, [float("nan")] * 5), (104, [0.0, 0.0, 0.0, 0.0, float("-inf")]), (105, [])]
    df = spark.createDataFrame([(i, e, "a", 1, None) for i, e in rows], VECTORS).repartition(3)
    found, centroids = C.cluster_vectors(df, clusters=4, rounds=3, dims=5)
    want, want_centroids = plain_clusters(rows, 4, 3, 5)
    assert centroids == want_centroids
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_clusters_of_few_or_no_vectors(spark):
    found, centroids = C.cluster_vectors(spark.createDataFrame([], VECTORS), dims=2)
    assert found.count() == 0 and centroids == []
    found, centroids = C.cluster_vectors(spark.createDataFrame([(1, [0.5, -0.0001], "", 0, "")], VECTORS), dims=2)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0)] and centroids == [[512, -1]]


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (8, 64))
    values = np.concatenate([c + rng.integers(-90, 90, (200, 64)) for c in middle])
    exact = ((values[:, None, :] - middle[None]) ** 2).sum(2)
    norms = C.segment_norms(values)
    assert (C.lower_bounds(norms, C.segment_norms(middle)) <= exact).all()
    nearest = C.Nearest(middle.tolist())
    best, least = nearest(values, norms)
    assert (best == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert nearest.tried < 0.5 * exact.size


def test_sums_of_any_size():
    for v in (0, 5, -5, 2**61, -(2**61), 2**200 + 17, -(2**200) - 17):
        assert sum(p[0] << (32 * k) for k, p in enumerate(C.limbs([v]))) == v
        assert all(abs(p[0]) < 2**63 for p in C.limbs([v]))


# Exact duplicates ------------------------------------------------------

DOCS = "doc_id long, text string, keep_id string, shared int, word long"


def test_dedup_equals_plain(spark):
    rng = random.Random(2)
    head = "same head of sixty-four characters and a few more to be beyond it: "
    texts = [None, "", "A", "a", "É", "é", "ab", "AB", "aB", "x" * 300_000, "X" * 300_000, head + "one", head + "two", head.upper() + "ONE", "two of it"]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "A"), (None, "only null id"), (None, "ONLY null id"), (5000, "twice"), (5000, "twice"), (5000, "TWICE"), (6000, "alone")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS).repartition(4)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(lower)].append(i)
    for hot in (1, 10, 1 << 20):
        found = exact_dedup(df, carry=["keep_id", "text"], digests=True, hot_rows=hot).collect()
        assert len(found) == len(rows)
        kept = Counter()
        for r in found:
            x = (r["carried"]["text"] or "").translate(lower)
            ids = groups[x]
            assert r["group_size"] == len(ids) and r["text_sha256"] == hashlib.sha256(x.encode()).hexdigest() and r["n_bytes"] == len(x.encode())
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["carried"]["keep_id"] == "k"
            if r["kept"]:
                kept[x] += 1
                assert r["doc_id"] == r["keep_id"]
        assert kept == Counter(groups.keys())


def test_whole_texts_are_read_only_where_needed(spark):
    df = spark.createDataFrame([(1, "long one"), (2, "short"), (3, "other"), (4, "SHORT"), (5, "a" * 70 + "b"), (6, "a" * 70 + "c"), (7, "c" * 71)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_sha256"] is not None for r in exact_dedup(df).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_dedup_of_nothing_and_rows_that_stay(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "A b", "p", 1, 1), (2, "a B", "q", 2, 2), (3, "c", None, None, None)], DOCS)
    assert sorted(r["doc_id"] for r in without_copies(df).collect()) == [2, 3]
    assert without_copies(df).columns == df.columns


def test_dedup_plan_shuffles_no_text(spark):
    plan = op12_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Alignment -------------------------------------------------------------

PATHS = T._paths(None, None)
ODD = [
    None, "", " ", "a", "don't stop", "<|endoftext|> is text", "<s>[INST] </s>", "▁ literal", "x▁y", "\0\x01", "naïve café — “quotes”", "日本語のテキスト", "🙂🙃 emoji 👩‍👩‍👧", "    indented\n\n\tcode  ", "a" * 300, "ab " * 50, " 　 wide", "1234567890" * 20,
    "ЖЖЖ" * 40, "é" * 50, "---" * 100, "\r\n" * 30, "﻿bom", "word", "word",
]


def plain_alignment(texts):
    aligner = T.Aligner(*PATHS)
    out, pairs = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b, want = aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t), (" " + t).encode()
            if b"".join(aligner.bytes_a[i] for i in a) == want == b"".join(aligner.bytes_b[i] for i in b):
                ends_a, ends_b = ([*accumulate(len(tokens[i]) for i in ids)] for tokens, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b)))
                cuts = sorted(set(ends_a) & set(ends_b))
                last = 0
                for cut in cuts:
                    groups.append(tuple([i for i, e in zip(ids, ends) if last < e <= cut] for ids, ends in ((a, ends_a), (b, ends_b))))
                    last = cut
        out.append(groups)
        pairs.update({(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in out:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(pairs[x] == best[x[0]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, out


@pytest.mark.parametrize("limits", [(8 << 20, 1 << 14, 1 << 12), (300, 7, 1)])
def test_alignment_equals_plain(spark, monkeypatch, limits):
    """Also with packs of few texts, short lists of pairs and all groups counted as wide ones."""
    monkeypatch.setattr(T, "PACK_BYTES", limits[0])
    monkeypatch.setattr(T, "LIST_PAIRS", limits[1])
    monkeypatch.setattr(T, "GROUP_LINKS", limits[2])
    texts = [*ODD, *[r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]]
    df = spark.createDataFrame([(i if i % 7 else None, t, i, "p") for i, t in enumerate(texts)], "doc_id long, text string, pack int, pairs string").repartition(3)
    want, _ = plain_alignment(texts)
    found = T.align_tokenizers(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i if i % 7 else None, *w)) for i, w in enumerate(want))


def test_groups_of_tokens(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    _, want = plain_alignment(ODD)
    got = defaultdict(list)
    for r in T.token_groups(df).orderBy("doc_id", "group").collect():
        assert r["group"] == len(got[r["doc_id"]]) and r["first_byte"] < r["end_byte"]
        got[r["doc_id"]].append((r["a_ids"], r["b_ids"]))
    assert all(got[i] == w for i, w in enumerate(want))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    words = ["the", "Größe", "don't", "x_1", "日本", "a  b", "12.5", "…", "tab\tbed", " "]
    text = " ".join(rng.choice(words) for _ in range(4000))
    aligner = T.Aligner(*PATHS)
    whole = aligner.encode([text])[0]
    monkeypatch.setattr(T, "PIECE", 50)
    assert len(aligner.pieces(text)) > 100 and " ".join(aligner.pieces(text)) == text
    assert aligner.encode([text])[0] == whole and whole[0]


def test_ranks_give_the_ids_of_the_file():
    rng = random.Random(4)
    texts = [" " + (t or "") for t in ODD] + ["".join(chr(rng.choice([32, 39, 9, 0xA0, 0x2003, rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(300)]
    aligner = T.Aligner(*PATHS)
    assert aligner.fast is not None
    assert aligner.encode_a(texts) == [x.ids for x in aligner.a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_nothing(spark):
    assert T.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = T.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_a"], r["count_sum"], r["groups_sha256"]) for r in only) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_query_equals_plain_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain_alignment([r["text"] for r in docs])
    found = QUERIES["op13_token_alignment"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted((r["doc_id"], *w) for r, w in zip(docs, want))


def test_cluster_query(spark):
    found = QUERIES["op11_centroid_clusters"](spark, SF).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = plain_clusters(rows, 8, 10, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == sorted(want)
    assert {r["inertia"] for r in found} == {sum(w[2] for w in want)}
    for r in found:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_cluster_query_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert C.op11_centroid_clusters(spark, str(tmp_path)).count() == 0
