"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Passages that share so many word pairs with a test item as a copy must (the
q-gram lemma) are aligned word by word with the item; the score tells how much
of the item the passage covers, edits included.  No passage that scores enough
(``required``) is left out, however short or frequent its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, carrying, chunks, lower_latin, mix, small_batches, table, texts_of

#: Words (or the whole item) that an alignment must gain however short the item is: fewer are no evidence.
LEAST_WORDS = 3
#: Seeds that a passage must share with an item before they are aligned, where a copy shares as many.
ENOUGH = 4
#: Rows of hits (of a seed in a text, for each item that has it) that are looked at together, about.
HIT_ROWS = 1 << 20
#: Words of a passage that are aligned at once; longer ones are cut into windows that overlap by more than a copy spans.
WINDOW = 1 << 14
#: Aligned share of an item from which a passage counts as a copy.
THRESHOLD = 0.45
#: Item text that one pass over the documents takes, which bounds what is broadcast.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0


def token_separators() -> np.ndarray:
    """ASCII blanks and signs; punctuation doesn't hide a copy."""
    t = np.ones(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = False
    return t


def hasher() -> WordHasher:
    return WordHasher(token_separators(), np.arange(256, dtype=np.uint8))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mix(h + np.uint64(n))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the range of the passage it ends in (start is a lower bound by score).

    Rows go over the item, whole rows of the passage at once; gaps inside a row
    are resolved by a running maximum.
    """
    n = len(passage)
    steps = np.arange(n + 1) * GAP
    above = np.zeros(n + 1)
    origin = np.arange(n + 1)
    best, end, start = 0.0, 0, 0
    for word in item:
        row = np.zeros(n + 1)
        took = np.where(passage == word, MATCH, MISMATCH)
        diagonal, up = above[:-1] + took, above[1:] + GAP
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        from_ = np.arange(n + 1)
        from_[1:] = np.where(row[1:] <= 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:]))
        shifted = row - steps
        run = np.maximum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted >= run, np.arange(n + 1), 0))
        filled = run + steps
        from_ = np.where(filled > row, from_[at], from_)
        above, origin = np.maximum(filled, 0), from_
        i = int(above.argmax())
        if above[i] > best:
            best, end, start = float(above[i]), i, int(origin[i])
    return best, start, end


def required(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """Alignment score from which a passage counts as a copy of an item of so many words."""
    return np.maximum(threshold * lengths, np.minimum(lengths, LEAST_WORDS)) - 1e-9


class Items:
    """A block of test items: word hashes, and for each seed hash the items that have it and where.

    Seeds are an item's word pairs; of an item of one word, the word.  A passage
    that scores s has m matches and at most m - s other columns, so its runs of
    matches hold at least s - 1 of the item's pairs.  ENOUGH of these (or all) are
    then among the pairs that remain when as many less are left out, whichever they
    are; those of the most items are.
    """

    def __init__(self, ids: list[int], texts: list[str], threshold: float = THRESHOLD):
        make = hasher()
        self.ids, self.words = [], []
        for i, text in zip(ids, texts):
            raw = lower_latin(np.frombuffer(text.encode(), np.uint8))
            words = make(raw, np.array([0, len(raw)]))[0]
            if len(words):
                self.ids.append(i)
                self.words.append(words)
        lengths = np.array([len(w) for w in self.words], np.int64)
        sizes = np.minimum(2, lengths)
        self.required = required(lengths, threshold)
        needed = np.maximum(1, np.ceil(self.required - 1)).astype(np.int64)
        #: Seeds that a passage must share, and columns of a copy that aren't matches, which shift its parts, at most.
        self.least = np.minimum(needed, ENOUGH)
        self.slack = np.maximum(4, np.ceil(lengths - self.required).astype(np.int64) + 1)
        self.sizes = np.unique(sizes)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        hashes = cat([ngram_hashes(w, int(n)) for w, n in zip(self.words, sizes)], np.uint64)
        grams = lengths - sizes + 1
        owner = np.repeat(np.arange(len(lengths)), grams)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(grams) - grams, grams)
        _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((at, times[number], owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = at  # positions count from 0 in each item, so they number the sorted rows too
        keep = rank < (grams - needed + self.least)[owner]
        order = np.flatnonzero(keep)[np.argsort(hashes[keep], kind="stable")]
        self.hashes, self.owner, self.at = hashes[order], owner[order], at[order]
        self.seeds = np.unique(self.hashes)


def seed_hits(words: np.ndarray, owner: np.ndarray, seeds: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of all seeds in the words of several texts (none across texts)."""
    places, found = [], []
    for n in sizes:
        h = ngram_hashes(words, int(n))
        if not len(h) or not len(seeds):
            continue
        at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        hit = np.flatnonzero((seeds[at] == h) & (owner[: len(h)] == owner[int(n) - 1 :]))
        places.append(hit)
        found.append(h[hit])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(found)


def spans(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``low`` and have ``n`` numbers, in turn."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def parts(sizes: np.ndarray, groups: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to ``most`` at most, or one group's; equal groups stand together and are never parted."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
        if b < len(sizes):
            b = max(int(np.searchsorted(groups, groups[b], "left")), int(np.searchsorted(groups, groups[a], "right")))
        yield a, b
        a = b


def passages(items: Items, text: np.ndarray, places: np.ndarray, hashes: np.ndarray):
    """(text, item, first and last place where the item would begin, seeds) of the passages that may share enough seeds with an item, from hits in order of texts.

    An item is looked at in a text only if enough of its seeds occur there at all,
    so a pair of words that a text repeats and many items have costs a row an
    item, not one for each place.  Where an item and a text still have more than
    HIT_ROWS hits, all from the first to the last is one passage.
    """
    order = np.lexsort((places, hashes, text))
    text, places, hashes = text[order], places[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    times, key_text = np.diff(np.append(first, len(order))), text[first]
    low, high = (np.searchsorted(items.hashes, hashes[first], side) for side in ("left", "right"))
    for a, b in parts(high - low, key_text, HIT_ROWS):
        rows = spans(low[a:b], (high - low)[a:b])
        key = np.repeat(np.arange(a, b), (high - low)[a:b])
        pair = key_text[key] * len(items.ids) + items.owner[rows]
        found, number, shared = np.unique(pair, return_inverse=True, return_counts=True)
        keep = np.flatnonzero((shared >= items.least[found % len(items.ids)])[number])
        keep = keep[np.argsort(pair[keep], kind="stable")]
        rows, key, pair, shared = rows[keep], key[keep], pair[keep], shared[number[keep]]
        for c, d in parts(times[key], pair, HIT_ROWS):
            if times[key[c:d]].sum() > HIT_ROWS:
                t, k = divmod(int(pair[c]), len(items.ids))
                ends = first[key[c:d]] + times[key[c:d]] - 1
                yield t, k, int(places[first[key[c:d]]].min()) - len(items.words[k]), int(places[ends].max()), int(shared[c])
                continue
            n = times[key[c:d]]
            at = np.repeat(items.at[rows[c:d]], n)
            yield from diagonals(items, np.repeat(pair[c:d], n), places[spans(first[key[c:d]], n)] - at, at)


def diagonals(items: Items, pair: np.ndarray, start: np.ndarray, at: np.ndarray):
    """The passages among hits of (text, item) pairs: hits whose starts lie within an item's slack of each other."""
    order = np.lexsort((start, pair))
    start, pair, at = start[order], pair[order], at[order]
    text, owner = pair // len(items.ids), pair % len(items.ids)
    new = np.ones(len(order), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (np.diff(start) > items.slack[owner[1:]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    longest = int(at.max()) + 1 if len(at) else 1
    seeds = np.bincount(np.unique(group * longest + at) // longest, minlength=len(first))
    enough = np.flatnonzero(seeds >= items.least[owner[first]])
    first, last = first[enough], last[enough]
    return zip(text[first].tolist(), owner[first].tolist(), start[first].tolist(), start[last].tolist(), seeds[enough].tolist())


def copies_in(items: Items, words: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple]:
    """(text, item, score, first word, word after, seeds) for each item's best passage in each of several texts; of equal ones, the first that is found."""
    places, hashes = seed_hits(words, owner, items.seeds, items.sizes)
    ends, best = np.searchsorted(owner, np.arange(texts + 1)), {}
    for t, k, low, high, seeds in passages(items, owner[places], places, hashes):
        item, slack = items.words[k], int(items.slack[k])
        lo, hi = max(int(ends[t]), low - slack), min(int(ends[t + 1]), high + len(item) + slack)
        step = max(WINDOW, len(item) + slack)
        for begin in range(lo, hi, step):
            score, s, e = align(item, words[begin : min(hi, begin + step + len(item) + slack)])
            if score >= items.required[k] and ((t, k) not in best or score / (MATCH * len(item)) > best[t, k][2]):
                at = begin - int(ends[t])
                best[t, k] = (t, items.ids[k], score / (MATCH * len(item)), at + s, at + e, seeds)
    return list(best.values())


def find_copies(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, carry=()) -> DataFrame:
    """doc_id, item_id, score (0 to 1), start_word, end_word and seeds: each document's best passage for each item it copies; carried, a struct of the columns in ``carry``.

    Every row of ``docs`` is read whole, once for each block of items of at most
    about ``block_bytes`` of text; a block is what is broadcast.  A passage is
    found if and only if its alignment gains ``threshold`` of the item's words, and
    LEAST_WORDS words or all of the item, however often its item or its words
    occur.  Of passages that score alike, one is reported.  Null or wordless texts
    on either side match nothing; repeated rows are reported each, null ids
    stay null.  Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tests = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in own], [r[1] for r in own], threshold)
        part = align_block(docs, items, carry)
        out = part if out is None else out.unionByName(part)
    return out


def align_block(docs: DataFrame, items: Items, carry=()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(items))  # plain values: a worker need not have this module to read them

    def work(batches):
        items, make = Items.__new__(Items), hasher()
        vars(items).update(shared.value)
        names = ["doc_id", "item_id", "score", "start_word", "end_word", "seeds"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            data, offsets = texts_of(b.column(1))
            ids, at, out = b.column(0).to_pylist(), [], []
            for low, high in chunks(offsets):
                words, owner, _, _ = make(lower_latin(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low])
                found = copies_in(items, words, owner, high - low)
                out += [(ids[low + t], *c) for t, *c in found]
                at += [low + t for t, *_ in found]
            if out:
                made = [pa.array(c, t) for c, t in zip(zip(*out), types)] + [c.take(pa.array(at)) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays(made, [*names, "carried"][: len(made)])

    return carrying(docs, ("doc_id long", "text string"), carry, work, "doc_id long, item_id long, score double, start_word long, end_word long, seeds long")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
