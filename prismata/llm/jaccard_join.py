"""Exact Jaccard join of word n-gram sets, and its connected components.

Tokens are hashed word shingles; a document's tokens are ordered by hash.  Two
sets of Jaccard similarity t share at least ``need(n) = ceil(t n)`` tokens, so
their first ``n - need(n) + k`` tokens share at least ``k`` (extended prefixes).

1. One pass over the texts sends extended prefixes, as packed arrays, to token
   ranges.  A range counts in how many distinct sets each token occurs.  A set
   with fewer than ``k`` shared prefix tokens has no partner and is done.
2. The few others get their whole sets.  Each is compared with the sets that
   lead most of its shared tokens, which joins large groups of near copies
   with one comparison a set or two.
3. What could still link two different components must share tokens between
   components, and ``need(n)`` of them.  Of these, in order of frequency, each
   set indexes its first ones singly where they are rare.  Frequent ones are
   indexed in pairs: the prefix is extended by as many tokens as there are hash
   groups, so a partner shares more of them than there are groups, two fall
   into one group, and pairs within a group are enough.  The number of groups
   follows the size of the set (its class, which a partner has or neighbours),
   so a set has a few entries for each token however many are frequent.
4. Sets connected by index entries form families.  Entries are linked within
   each task first, so that a frequent entry is sent once a task.  Blocks of a
   family are verified by counting shared tokens along inverted lists; only
   links that join components leave the block, and the sets of a family's main
   component are never compared with each other.

Equal sets are one node, so copies are never compared.  Nodes and tokens are
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, WordHasher, ascii_lower, chunks, delete, mix, release, released, scratch_path, small_batches, small_side, space_bytes, stash, table, texts_of, unstash

SHINGLE, PERCENT = 5, 80
#: Prefix tokens that a task gathers before it packs them.
PACK = 400_000
#: Token ranges at least; bytes of text for a range beyond that.
RANGES, RANGE_BYTES = 48, 32 << 20
#: Sets that may hold a token indexed singly; more frequent ones are indexed in pairs within hash groups.
FREQUENT = 256
#: Ratio of the sizes in a class (above that of partners), and hash groups at least and for each token of a set.
CLASS, LEAST_GROUPS, GROUPS = 4 / 3, 3, 0.1
#: Sets of a family that are verified together; a larger family is verified by pairs of blocks.
BLOCK = 512
#: Edges that one task joins to components; more are joined by alternating stars, in partitions of as many.
SMALL_ROWS = 1_000_000

_PASS1 = "kind int, id long, key long, n long, node long, leader long, part int, tokens binary, nodes binary, flags binary"


def need(n, percent: int = PERCENT):
    """Tokens that a set of n shares with any partner, at least."""
    return (percent * n + 99) // 100


def extra(n):
    """Tokens by which the prefix is extended."""
    return np.maximum(2, n // 10)


def shingle_sets(make: WordHasher, data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the text of each.

    A text of fewer than ``size`` words has its whole sequence as one shingle.
    """
    words, owner, _, _ = make(data, offsets)
    texts = len(offsets) - 1
    count = np.bincount(owner, minlength=texts)
    m = max(0, len(words) - size + 1)
    h = np.zeros(m, np.uint64)
    for i in range(size):
        h = h * np.uint64(MULT) + words[i : i + m]
    inside = owner[:m] == owner[size - 1 :] if m else np.zeros(0, bool)
    h, own = mix(h[inside]), owner[:m][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = []
        for a, c in zip(first.tolist(), count[short].tolist()):
            x = c
            for w in words[a : a + c].tolist():
                x = (x * MULT + w) & (2**64 - 1)
            whole.append(x)
        h, own = np.concatenate([h, mix(np.array(whole, np.uint64))]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]


def set_nodes(h: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set and a hash of the set (0 for the empty set)."""
    n = np.bincount(own, minlength=texts)
    node = np.zeros(texts, np.uint64)
    if len(h):
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        node[own[heads]] = mix(np.add.reduceat(mix(h ^ np.uint64(0x51ED270B0F1C2A37)), heads) + n[own[heads]].astype(np.uint64))
    return n, node.view(np.int64)


def leaders(tokens: np.ndarray, nodes: np.ndarray):
    """Distinct (token, node) pairs in order, each token's number of nodes, least and greatest node."""
    order = np.lexsort((nodes, tokens))
    t, d = tokens[order], nodes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    keep = np.flatnonzero(new)
    t, d = t[keep], d[keep]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, int)
    sizes = np.diff(np.r_[heads, len(t)])
    return order[keep], t, d, np.repeat(sizes, sizes), np.repeat(d[heads], sizes), np.repeat(d[heads + sizes - 1], sizes) if len(t) else d


def tally(node: np.ndarray, leader: np.ndarray, counts: np.ndarray):
    """Sums of counts by (node, leader)."""
    order = np.lexsort((leader, node))
    node, leader, counts = node[order], leader[order], counts[order]
    heads = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (leader[1:] != leader[:-1])]) if len(node) else np.zeros(0, int)
    return node[heads], leader[heads], np.add.reduceat(counts, heads) if len(node) else counts


def prefix_pass(docs: DataFrame, parts: int, size: int, percent: int) -> DataFrame:
    """Rows of three kinds: 0 each document's set, 1 packed prefixes by token range, 2 sharing found within a task.

    A token that several sets of a pack have is sent once, by its leader, so a
    frequent token costs an entry for each pack, however many documents have it.
    """

    def batch(**cols):
        n = len(next(iter(cols.values())))
        types = dict(kind=pa.int32(), id=pa.int64(), key=pa.int64(), n=pa.int64(), node=pa.int64(), leader=pa.int64(), part=pa.int32(), tokens=pa.binary(), nodes=pa.binary(), flags=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in types.items()], list(types))

    def pack(tokens, nodes):
        tokens, nodes = np.concatenate(tokens), np.concatenate(nodes)
        _, t, d, df, low, high = leaders(tokens, nodes)
        shared = df > 1
        for lead in (low, high):
            a, b, c = tally(d[shared], lead[shared], np.ones(int(shared.sum()), np.int64))
            # either leader tells of the same tokens: they count once
            yield batch(kind=np.full(len(a), 2), node=a, leader=b, n=c if lead is low else np.zeros_like(c))
        keep = ~shared | (d == low)
        t, d, flag = t[keep], d[keep], shared[keep].astype(np.uint8)
        part = ((mix(t) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        t, d, flag, part = t[order], d[order], flag[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        own = [p for p in range(parts) if edges[p] < edges[p + 1]]
        cut = lambda x: [x[edges[p] : edges[p + 1]].tobytes() for p in own]
        yield batch(kind=np.ones(len(own), int), part=np.array(own), tokens=cut(t), nodes=cut(d), flags=cut(flag))

    def work(batches):
        make = WordHasher(space_bytes(), ascii_lower())
        tokens, nodes, held = [], [], 0
        for b in batches:
            data, offsets = texts_of(b.column(1))
            for low, high in chunks(offsets):
                h, own = shingle_sets(make, data, offsets[low : high + 1], size)
                n, node = set_nodes(h, own, high - low)
                yield batch(kind=np.zeros(high - low, int), id=b.column(0).slice(low, high - low), key=b.column(2).slice(low, high - low), n=n, node=node)
                rank = np.arange(len(h)) - np.searchsorted(own, own)
                keep = (rank < (n - need(n, percent) + extra(n))[own]) & (n > 3)[own]
                tokens.append(h[keep])
                nodes.append(node[own[keep]])
                held += int(keep.sum())
                if held >= PACK:
                    yield from pack(tokens, nodes)
                    tokens, nodes, held = [], [], 0
        if held:
            yield from pack(tokens, nodes)

    return docs.mapInArrow(released(work), _PASS1)


def count_ranges(packed: DataFrame) -> DataFrame:
    """node, leader, n for the sharing that each token range finds between packs."""

    def work(pdf):
        import pandas as pd

        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]])
        nodes = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["flags"]])
        at, _, d, df, low, high = leaders(tokens, nodes)
        shared = df > 1
        d, once = d[shared], 1 - flags[at][shared].astype(np.int64)
        out = [tally(d, low[shared], once), tally(d, high[shared], np.zeros_like(once))]
        release()
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("node", "leader", "n"))})

    return packed.groupBy("part").applyInPandas(work, "node long, leader long, n long")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, n and tokens (ascending) of each text."""

    def work(batches):
        make = WordHasher(space_bytes(), ascii_lower())
        for b in batches:
            data, offsets = texts_of(b.column(0))
            for low, high in chunks(offsets):
                h, own = shingle_sets(make, data, offsets[low : high + 1], size)
                n, node = set_nodes(h, own, high - low)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64)), lists], ["node", "n", "tokens"])

    return docs.select("text").mapInArrow(released(work), "node long, n long, tokens array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    both = F.size(F.array_intersect("ta", "tb"))
    return joined.where(both * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (a, b) in ascending order, and the least node connected to each."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ids[: len(a)], ids[len(a) :]
    up = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while not np.array_equal(up, over := up[up]):
            up = over
    return nodes, nodes[up]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that connect the same nodes, one for each node and PACK rows of a task."""

    def work(batches):
        def forest():
            node, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            own = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], ["a", "b"])

        held, n = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n >= PACK:
                yield forest()
                held, n = [], 0
        if held:
            yield forest()

    return edges.select("a", "b").mapInArrow(released(work), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of the edges (a, b); a stash.

    Up to SMALL_ROWS edges (after each task has contracted its own) are joined
    by one task.  More go through rounds of alternating stars, where the nodes
    with the most edges take their least neighbour by broadcast: at most 1,000,
    as only those count that have over a thousandth of all edges.
    """
    now = stash(contracted(edges), "cc")
    count = now.count()
    if count <= SMALL_ROWS:

        def work(batches):
            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if held:
                node, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

        out = stash(now.coalesce(1).mapInArrow(released(work), "node long, component long"), "components")
        unstash(now)
        return out
    before = None
    while True:
        parts = max(1, -(-count // max(SMALL_ROWS, 1)))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "cc-least")
        hubs = F.broadcast(least.where(F.col("n") * 1000 > 2 * count).select("a", F.col("m").alias("hub")))
        flagged = both.join(hubs, "a", "left")
        far = flagged.where("hub IS NULL").select("a", "b").join(least.select("a", "m"), "a").unionByName(flagged.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")))
        large = stash(far.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts), "cc-large")
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b")))
        after = stash(contracted(small.where("a <> b").distinct().coalesce(parts)).distinct(), "cc")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for done in (now, least, large):
            unstash(done)
        now, count = after, state[0]
        if state == before:
            break
        before = state
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = stash(out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    unstash(now)
    return out


def cross_tokens(sets: DataFrame, share: str) -> tuple[DataFrame, DataFrame]:
    """node, component, n, tokens and own: its tokens that other components have too, (frequency, token) ascending.

    Sets with fewer such tokens than the expression ``share`` are left out.  The
    second frame is a stash that the first one reads: with a table on either
    side, Spark splits the join where a token is very frequent.
    """
    rows = sets.select("node", "component", F.explode("tokens").alias("token"))
    both = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    both = stash(both.where("low <> high").select("token", "df"), "jaccard-cross")
    own = rows.select("node", "token").join(both, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    return sets.join(own, "node").where(f"size(own) >= {share}"), both


def index_entries(sets: DataFrame, percent: int) -> DataFrame:
    """node, entry: rare tokens of each set's prefix, and pairs of frequent ones of the longer prefix within a hash group.

    Sets index pairs for their own size class and the next one, so that
    partners, whose classes differ by one at most, have one in common.
    """
    first = F.size("own") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    singly = F.transform(F.filter(F.slice("own", F.lit(1), first), lambda x: x["df"] <= FREQUENT), lambda x: x["token"])
    rows = sets.select("node", "own", first.alias("first"), singly.alias("singly"), F.floor(F.log("n") / float(np.log(CLASS))).cast("int").alias("class"))
    frequent = rows.where(F.exists(F.slice("own", F.lit(1), F.col("first")), lambda x: x["df"] > FREQUENT))
    frequent = frequent.select("node", "own", "first", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    groups = F.greatest(F.lit(LEAST_GROUPS), F.ceil(F.pow(F.lit(CLASS), F.col("class")) * GROUPS)).cast("int")
    frequent = frequent.withColumn("groups", groups)
    often = F.transform(F.filter(F.slice("own", F.lit(1), F.col("first") + F.col("groups")), lambda x: x["df"] > FREQUENT), lambda x: F.struct(F.pmod(F.xxhash64(F.lit("group"), x["token"]), F.col("groups")).alias("group"), x["token"].alias("token")))
    frequent = frequent.select("node", "class", F.array_sort(often).alias("often"))
    pairs = F.transform(F.col("often"), lambda x, i: F.transform(F.filter(F.slice("often", i + 2, F.size("often")), lambda y: y["group"] == x["group"]), lambda y: F.xxhash64("class", x["token"], y["token"])))
    return rows.select("node", F.explode("singly").alias("entry")).unionByName(frequent.select("node", F.explode(F.flatten(pairs)).alias("entry")))


def families(entries: DataFrame) -> DataFrame:
    """node, component (the family): sets that index entries connect; a stash.

    Each task links the sets of PACK entries, keeps the links and sends each
    entry once, with one of its sets; what follows an entry's first set in the
    task that gets it is linked with that one.
    """

    def local(batches):
        def pack():
            entry, node = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.lexsort((node, entry))
            entry, node = entry[order], node[order]
            first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
            low = np.repeat(node[first], np.diff(np.r_[first, len(entry)]))
            nodes, root = roots(node, low)
            own = nodes != root
            yield pa.RecordBatch.from_arrays([pa.nulls(int(own.sum()), pa.int64()), pa.array(nodes[own]), pa.array(root[own])], ["entry", "node", "root"])
            at = root[np.searchsorted(nodes, node[first])]
            yield pa.RecordBatch.from_arrays([pa.array(entry[first]), pa.array(at), pa.nulls(len(first), pa.int64())], ["entry", "node", "root"])

        held, n = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n >= PACK:
                yield from pack()
                held, n = [], 0
        if held:
            yield from pack()

    def link(batches):
        last = None
        for x in batches:
            entry, node = x.column(0).to_numpy(), x.column(1).to_numpy()
            if not len(entry):
                continue
            first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
            lead = node[first].copy()
            if last is not None and last[0] == entry[0]:
                lead[0] = last[1]
            low = np.repeat(lead, np.diff(np.r_[first, len(entry)]))
            last = entry[-1], low[-1]
            nodes, root = roots(node, low)
            own = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["a", "b"])

    packed = stash(entries.select("entry", "node").mapInArrow(released(local), "entry long, node long, root long"), "jaccard-entries")
    met = packed.where("entry IS NOT NULL").select("entry", "node").repartition("entry").sortWithinPartitions("entry")
    edges = met.mapInArrow(released(link), "a long, b long").unionByName(packed.where("entry IS NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    out = components(edges)
    unstash(packed)
    return out


def family_links(sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that join components (column component of ``sets``) within each family (that of ``named``).

    Tokens that only one component has are not in ``own``, so shared counts are
    exact between components.  The sets of a family's main component (that of
    the most sets) and the others are cut into blocks by hash; each pair of
    blocks of which one at least is of others is a group.
    """
    placed = sets.select("node", "component").join(named.select("node", F.col("component").alias("family")), "node")
    counts = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.groupBy("family").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("all"))
    k = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = counts.where("main.m < all").select("family", F.col("main.component").alias("main"), k(F.col("main.m")).alias("mains"), k(F.col("all") - F.col("main.m")).alias("others"))
    rows = sets.select("node", "n", "component", F.transform("own", lambda x: x["token"]).alias("tokens")).join(placed.select("node", "family"), "node").join(counts, "family")
    rest = F.col("component") != F.col("main")
    at = F.when(rest, F.pmod(F.xxhash64("node"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).cast("int")
    to = F.when(rest, F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    rows = rows.withColumn("other", F.explode(to)).withColumn("mine", at)
    rows = rows.select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "n", "component", "tokens")

    def verify(pdf):
        import pandas as pd

        node, n = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        sizes = np.array([len(x) for x in pdf["tokens"]])
        tokens = np.concatenate([np.asarray(x, np.int64) for x in pdf["tokens"]])
        _, ids, df = np.unique(tokens, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(node)), sizes)
        posting = owner[np.argsort(ids, kind="stable")]
        start = np.cumsum(df) - df
        names, root, count = np.unique(pdf["component"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        root = root.copy()  # component of each set, merged as links are found
        most, out = int(count.argmax()), []
        ends = np.cumsum(sizes)
        for x in np.flatnonzero(root != most).tolist():  # of two components one is not the largest
            own = ids[ends[x] - sizes[x] : ends[x]]
            d = df[own]
            at = np.repeat(start[own] - np.cumsum(d) + d, d) + np.arange(d.sum())
            shared = np.bincount(posting[at], minlength=len(node))
            for y in np.flatnonzero((shared * (100 + percent) >= percent * (n + n[x])) & (root != root[x])).tolist():
                if root[y] != root[x]:
                    out.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        release()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("family", "low", "high").applyInPandas(verify, "a long, b long")


def labelled(sets: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return sets.withColumn("component", F.col("node"))
    return sets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of each document.

    Documents link when ``100 * intersection >= percent * union`` of their sets
    of ``size``-word shingles.  Documents without words or text have an empty
    set and stand alone.  Repeated rows and rows that share a doc_id are judged
    by their own text; a null doc_id never names a component unless all of it
    are null.  Other columns are left out.  ``percent`` must be over 75, so that
    sets of up to three shingles link only with equal ones.

    ``keyed`` adds each row's key (xxhash64 of its text), which with its doc_id
    tells rows apart that share one of them, and lead: doc_id and key of the
    first row of its component by doc_id (null last) and key, null for an empty set.
    """
    if not 75 < percent <= 100:
        raise ValueError("percent must be from 76 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("key", F.xxhash64("text") if keyed else F.lit(None).cast("long"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(RANGES, -(-total // RANGE_BYTES))

    path = scratch_path(spark, "jaccard")
    prefix_pass(docs, parts, size, percent).write.partitionBy("kind").parquet(path)
    read = lambda kind: spark.read.schema(_PASS1.split(", ", 1)[1]).parquet(f"{path}/kind={kind}")
    one = spark.read.schema(_PASS1).parquet(path)
    if one.where("kind = 0").isEmpty():
        lead = F.lit(None).cast("struct<doc_id: bigint, key: bigint>").alias("lead")
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), *(["key", lead] if keyed else []))
    rows = read(0).select(F.col("id").alias("doc_id"), "n", "node", "key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), *([F.min(order).alias("lead")] if keyed else []))

    found = count_ranges(one.where("kind = 1")).unionByName(one.where("kind = 2").select("node", "leader", "n"))
    dealt = found.repartition("node").groupBy("node", "leader").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    best = dealt.groupBy("node").agg(F.sum("n").alias("shared"), F.sort_array(F.collect_list(F.struct("n", "rows", "leader")), False).alias("leads"))
    bar = F.greatest(F.lit(2), F.floor(F.ceil(F.col("n") * percent / F.lit(100)) / 10))
    few = best.join(nodes, "node").where(F.col("shared") >= bar)
    chosen = F.slice(F.filter("leads", lambda x: x["leader"] != F.col("node")), 1, 2)
    few = stash(few.select("node", "n", "least", F.transform(chosen, lambda x: x["leader"]).alias("leads")), "jaccard-few")
    for kind in (1, 2):
        delete(spark, f"{path}/kind={kind}")

    side = small_side(few.select(F.col("least").alias("id")).distinct())
    own = docs.join(side, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = whole_sets(own, size)
    sets = stash(sets.join(few.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")

    stars = few.select(F.col("node").alias("a"), F.explode("leads").alias("b"))
    edges = stash(verified(stars, sets, percent).coalesce(16), "jaccard-links")
    parts_ = components(edges)

    # what may still link components: first by prefixes, then by whole sets
    reach = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    short = labelled(sets.select("node", "n", F.slice("tokens", F.lit(1), reach.cast("int")).alias("tokens")), parts_)
    left, cross = cross_tokens(short, f"greatest(2, floor(ceil(n * {percent} / 100) / 10))")
    left = stash(left.select("node").coalesce(16), "jaccard-left")
    rest, again = cross_tokens(labelled(sets.join(left, "node", "left_semi"), parts_), f"ceil(n * {percent} / 100)")
    rest = stash(rest.select("node", "n", "component", "own"), "jaccard-rest")
    named = families(index_entries(rest, percent))
    more = stash(family_links(rest, named, percent).coalesce(16), "jaccard-links")
    for done in (parts_, named, cross, again):
        unstash(done)
    parts_ = components(edges.unionByName(more))

    named = nodes.join(parts_, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = ["lead"] if keyed else []
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), *[F.min(c).alias(c) for c in lead])
    ids = stash(named.drop(*lead).join(ids, "component").select("node", "component_id", *lead), "jaccard-ids")
    for done in (few, sets, left, rest, edges, more, parts_):
        unstash(done)
    out = rows.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["key", F.when(F.col("n") > 0, F.struct("lead.doc_id", "lead.key")).alias("lead")] if keyed else []))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) > 0
  )
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
