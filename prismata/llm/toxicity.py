"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word (two hashes, so that
one collision counts half) and of its beginnings.  Filters of several widths
slide over the words; the maximum of each over the whole text and the text's
length, as maxima grow with it, enter a logistic layer.  Some embedding
dimensions start from how strongly their bucket goes with the labels, which
tells the max pooling where to look.  All labelled rows, whole, are trained on.
They are dealt to packs of bounded size; in each round every pack trains a copy
of the net for an epoch, and the mean of the copies is the net of the next.  The
rows of a pack fall into folds: each row is trained on, and scored for the
thresholds, with starting figures of the other folds of all packs, where its own
label has no part.  Decision thresholds are
calibrated for each language, drawn towards the common one where it has few
toxic rows.  A text's language is told by the text alone, from the languages'
most common words; its logit is moved by what the language's threshold is off
the common one, so that one threshold, 0.3, holds for all scores.
"""

from __future__ import annotations

import io
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, ascii_lower, carrying, chunks, distinct, mix, released, residue, scratch, small_batches, small_side, stash, table, texts_of

#: Bytes of labelled text in a pack, about, and bytes that a row counts for besides its text.
PACK_BYTES, ROW_BYTES = 8 << 20, 64
#: Words of a pack that are counted at once.
SLICE = 1 << 18
#: A text of more words is pooled by itself in training, others together.
TRAIN_WORDS = 3000
BUCKETS, DIM = 1 << 20, 6
#: Ranges of buckets whose figures and steps are summed by themselves.
SHARDS = 16
SHARD_SIZE = BUCKETS // SHARDS
#: Bytes of the word beginnings that have embeddings of their own (0: the word itself, by either hash).
PREFIXES = (0, 0, 4, 5, 6, 7)
#: The embedding dimension that holds each one's starting figure.
PLACES = (0, 0, 1, 2, 3, 4)
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, RATE, BATCH, FOLDS = 4, 0.02, 64, 4
#: A bucket's starting figure at most, and the log-odds off the expected ones from which it can be that: however
#: many rows there are, frequent words that hardly differ tell little.
SURE, STRONG = 4.0, 3.0
#: What it costs to call all clean rows toxic, where missing all toxic ones costs 1.
CLEAN = 4.0
#: For the thresholds, logits count by bins: so many, up to this logit on either side.
BINS, FAR = 4096, 16.0
#: Share of a language's texts that have a word which tells of it, and such words of a language at most.
COMMON, MARKS = 0.3, 64
#: Toxic rows of a language at which its own threshold and the common one count the same.
SHRINK = 10
#: Scores from here on count as toxic.
THRESHOLD = 0.3


def word_separators() -> np.ndarray:
    """ASCII signs and blanks; letters, digits and all non-ASCII bytes belong to words."""
    t = np.ones(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = False
    return t


class Features:
    """Bucket numbers (words x len(PREFIXES)) of many texts at once, and the text of each word."""

    def __init__(self):
        self.hasher = WordHasher(word_separators(), ascii_lower())

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hashed(data, offsets)[1:]

    def hashed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after a hash of each word."""
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        hashes, owner, first, last = self.hasher(data, offsets)
        out = np.empty((len(hashes), len(PREFIXES)), np.int32)
        for k, size in enumerate(PREFIXES):
            if size == 0:
                h = hashes
            else:  # the first bytes of each word, as one number
                h = np.zeros(len(first), np.uint64)
                folded = self.hasher.fold[data]
                for i in range(size):
                    at = first + i
                    h = (h << np.uint64(8)) | np.where(at < last, folded[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint64)
            out[:, k] = mix(h ^ np.uint64(0x1234567 * (k + 1))) & np.uint64(BUCKETS - 1)
        return hashes, out, owner

    def numbered(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The numbers of each text's words; the bucket numbers and hashes (ascending) of the distinct words."""
        offsets = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, met, own = [], [], []
        for low, high in chunks(offsets):
            h, feats, owner = self.hashed(data, offsets[low : high + 1])
            new, at = np.unique(h, return_index=True)
            met.append((new, feats[at]))
            hashes += np.split(h, np.searchsorted(owner, np.arange(1, high - low)))
        if not met:
            return [], np.zeros((0, len(PREFIXES)), np.int32), np.zeros(0, np.uint64)
        words, at = np.unique(np.concatenate([x for x, _ in met]), return_index=True)
        return [np.searchsorted(words, h).astype(np.int32) for h in hashes], np.concatenate([x for _, x in met])[at], words


def windows_max(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row maxima of each text (0 for a text without rows) and the row of each maximum (-1)."""
    out, where = np.zeros((n, values.shape[1]), np.float32), np.full((n, values.shape[1]), -1)
    if len(owner):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        texts = owner[heads]
        out[texts] = np.maximum.reduceat(values, heads)
        for t, a, b in zip(texts.tolist(), heads.tolist(), [*heads[1:].tolist(), len(owner)]):
            where[t] = values[a:b].argmax(0) + a
    return out, where


@dataclass
class Pack:
    """Labelled rows whose words have numbers of their own; ``buckets`` are the distinct ones, ascending, and ``words`` their places."""

    langs: np.ndarray
    labels: np.ndarray
    fold: np.ndarray
    ids: np.ndarray  # the words of all texts, as places in ``words``
    ends: np.ndarray
    buckets: np.ndarray
    words: np.ndarray  # distinct words x len(PREFIXES)
    hashes: np.ndarray  # of the distinct words

    @classmethod
    def of(cls, rows: list[tuple]) -> Pack:
        """From (language's number, label, text as bytes) rows; their order does not matter."""
        rows = sorted(rows, key=lambda x: (x[1], x[0], len(x[2]), zlib.crc32(x[2])))
        feats, words, hashes = Features().numbered([x[2] for x in rows])
        buckets, places = np.unique(words, return_inverse=True)
        fold = np.arange(len(rows)) % FOLDS  # sorted by label, language and length: alike in all folds
        kind = np.uint16 if len(words) < 1 << 16 else np.int32
        ids = np.concatenate(feats).astype(kind) if feats else np.zeros(0, kind)
        return cls(np.array([x[0] for x in rows], np.int32), np.array([x[1] for x in rows], np.int32), fold, ids, np.cumsum([len(f) for f in feats], dtype=np.int64), buckets.astype(np.int32), places.reshape(words.shape).astype(np.int32), hashes)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return zlib.compress(out.getbuffer(), 1)

    @classmethod
    def load(cls, raw) -> Pack:
        with np.load(io.BytesIO(zlib.decompress(raw)), allow_pickle=False) as x:
            return cls(**{k: x[k] for k in x.files})

    def text(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]

    def passes(self, rows: np.ndarray):
        """(rows, bucket places, owners) that are pooled at once: the texts of up to TRAIN_WORDS words, and each longer one."""
        sizes = self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)
        for own in [rows[sizes <= TRAIN_WORDS], *rows[sizes > TRAIN_WORDS, None]]:
            if len(own):
                texts = [self.text(i) for i in own]
                yield own, self.words[np.concatenate(texts)], np.repeat(np.arange(len(own)), [len(x) for x in texts])

    def slices(self):
        """(first, last) of the texts that are counted at once: of about SLICE words, or one longer text."""
        return chunks(np.r_[0, self.ends], SLICE)

    def seen(self) -> np.ndarray:
        """The number of texts that have each word, by language of the pack."""
        names, number = np.unique(self.langs, return_inverse=True)
        out = np.zeros((len(names), len(self.hashes)), np.int64)
        for text, word in self.pairs():
            np.add.at(out, (number[text], word), 1)
        return out

    def pairs(self):
        """(text, word) of the distinct words of each text, by slices."""
        size = max(1, len(self.hashes))
        for low, high in self.slices():
            begin = self.ends[low - 1] if low else 0
            owner = np.repeat(np.arange(low, high), np.diff(self.ends[low:high], prepend=begin))
            pairs = distinct(owner * size + self.ids[begin : self.ends[high - 1]])
            yield (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)

    def counts(self, rates: np.ndarray):
        """(shard, keys, counts) of the texts that have each bucket, the toxic ones and those expected to be (by their languages' rates), by fold; a key is a place in PREFIXES and a bucket."""
        held, size = list(self.pairs()), len(self.buckets)
        for k in range(len(PREFIXES)):
            n = np.zeros((3, size * FOLDS), np.float32)
            for text, word in held:
                pairs = distinct(text.astype(np.int64) * size + self.words[word, k])
                of = pairs // size
                at = pairs % size * FOLDS + self.fold[of]
                for i, x in enumerate((None, self.labels[of], rates[self.langs[of]])):
                    n[i] += np.bincount(at, x, size * FOLDS)
            own = n.reshape(3, size, FOLDS)
            met = np.flatnonzero(own[0].any(1))
            for shard, low, high in shards_of(self.buckets[met]):
                yield shard, (self.buckets[met[low:high]] + k * BUCKETS).astype(np.int32), own[:, met[low:high]].transpose(1, 0, 2)

    def common(self) -> np.ndarray:
        """Hashes of the words that at least COMMON of a language's texts in this pack have."""
        n = np.unique(self.langs, return_counts=True)[1]
        return self.hashes[(self.seen() >= COMMON * n[:, None]).any(0)]


def shards_of(buckets: np.ndarray):
    """(shard, first, last) of the shards that ascending buckets have."""
    edges = np.searchsorted(buckets, np.arange(SHARDS + 1) * SHARD_SIZE)
    for shard in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield shard, int(edges[shard]), int(edges[shard + 1])


def starting_figures(counts: np.ndarray) -> np.ndarray:
    """Starting figures of a shard, for each fold from the other ones, and last from all rows.

    ``counts`` (places in PREFIXES x buckets x 3 x FOLDS) has the numbers of texts
    that have a bucket, of the toxic ones, and of those expected to be.  A
    bucket's figure is the signed root of its likelihood ratio against the
    expected rate, so that languages with more toxic rows don't count for their
    words.
    """
    out = np.zeros((FOLDS + 1, counts.shape[1], len(set(PLACES))), np.float16)
    for k, place in enumerate(PLACES):
        met = np.flatnonzero(counts[k][:, 0].any(1))
        own = counts[k][met]
        for i in range(FOLDS + 1):
            n, h, due = (own.sum(2) - (own[:, :, i] if i < FOLDS else 0)).T
            some = np.maximum(n, 1)
            p, rate = h / some, np.clip(due / some, 0.01, 0.99)
            gain = h * np.log(np.maximum(p, 1e-12) / rate) + (n - h) * np.log(np.maximum(1 - p, 1e-12) / (1 - rate))
            off = np.log((h + rate) / (n - h + 1 - rate)) - np.log(rate / (1 - rate))  # with one text more, of the expected rate
            most = SURE * np.minimum(np.abs(off) / STRONG, 1)
            out[i, met, place] += np.where(n > 0, np.sign(p - rate) * np.minimum(np.sqrt(np.maximum(gain, 0)), most), 0) / PLACES.count(place)
    return out


class Figures:
    """Compressed figures by (shard, fold); FOLDS for those of all rows."""

    def __init__(self, parts: dict[tuple[int, int], bytes]):
        self.parts = parts

    def of(self, fold: int, buckets: np.ndarray) -> np.ndarray:
        """The figures of ascending buckets."""
        out = np.zeros((len(buckets), len(set(PLACES))), np.float16)
        for shard, low, high in shards_of(buckets):
            if raw := self.parts.get((shard, fold)):
                own = np.frombuffer(zlib.decompress(raw), np.float16).reshape(SHARD_SIZE, -1)
                out[low:high] = own[buckets[low:high] - shard * SHARD_SIZE]
        return out


@dataclass
class ConvNet:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width * DIM x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # of the pooled filters, then of the length
    offset: float

    @classmethod
    def start(cls, rate: float = 0.5, seed: int = 11) -> ConvNet:
        """Filters 0 to 4 of each width read one of the dimensions with starting figures each."""
        rng = np.random.Generator(np.random.PCG64(seed))

        def scale(*shape):
            x = rng.standard_normal(shape, np.float32)
            x *= 0.05
            return x

        k = FILTERS * len(WIDTHS)
        net = cls(scale(BUCKETS, DIM), [scale(w * DIM, FILTERS) for w in WIDTHS], np.zeros(k, np.float32), np.append(scale(k) * 0.2, 0).astype(np.float32), float(np.log(rate / (1 - rate)) - 3.0))
        for w in net.filters:
            for place in set(PLACES):
                w[place::DIM, place] = 1.0 / (len(w) // DIM)
        for place in set(PLACES):
            net.weights[place] = 0.4  # width 1
        return net

    def part(self, buckets: np.ndarray) -> ConvNet:
        """A copy with the rows of these buckets alone."""
        return ConvNet(self.table[buckets].astype(np.float32), [w.copy() for w in self.filters], self.bias.copy(), self.weights.copy(), self.offset)

    def params(self) -> dict[str, np.ndarray]:
        """What Adam trains."""
        return {"bias": self.bias, "weights": self.weights, **{f"f{i}": w for i, w in enumerate(self.filters)}}

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        out = self.table[feats[:, 0]]
        for k in range(1, feats.shape[1]):
            out = out + self.table[feats[:, k]]
        return out

    def pool(self, feats: np.ndarray, owner: np.ndarray, n: int, places: bool = False):
        """Pooled activations and length (n x all filters and 1) and, on demand, the first word of each winning window (-1: none)."""
        x = self.vectors(feats)
        pooled, at = [], []
        for i, w in enumerate(self.filters):
            width = len(w) // DIM
            m = len(x) - width + 1
            if m <= 0:
                pooled.append(np.zeros((n, FILTERS), np.float32))
                at.append(np.full((n, FILTERS), -1))
                continue
            act = x[:m] @ w[:DIM]
            for j in range(1, width):
                act += x[j : j + m] @ w[j * DIM : (j + 1) * DIM]
            act += self.bias[i * FILTERS : (i + 1) * FILTERS]
            np.maximum(act, 0, out=act)
            if width > 1:
                inside = np.flatnonzero(owner[:m] == owner[width - 1 :])
                act, own = act[inside], owner[:m][inside]
            else:
                inside, own = None, owner
            if places:
                top, where = windows_max(act, own, n)
                at.append(where if inside is None else np.where(where >= 0, inside[where] if len(inside) else where, -1))
            else:
                top = np.zeros((n, FILTERS), np.float32)
                if len(own):
                    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    top[own[heads]] = np.maximum.reduceat(act, heads)
            pooled.append(top)
        pooled.append(np.log1p(np.bincount(owner, minlength=n)).astype(np.float32)[:, None])
        return np.concatenate(pooled, 1), np.concatenate(at, 1) if places else None

    def logits(self, feats: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return (self.pool(feats, owner, n)[0] @ self.weights).astype(np.float64) + self.offset

    def train(self, pack: Pack, figures: list[np.ndarray], weight: np.ndarray, moments: np.ndarray, step: int, seed: list[int]) -> tuple[np.ndarray, int]:
        """An epoch of Adam on the weighted cross-entropy, a fold at a time with its starting figures; embeddings get sparse steps of the same rate.

        ``moments`` (2 x parameters) and ``step`` are Adam's; they come back as they are then.
        """
        rng = np.random.Generator(np.random.PCG64(seed))
        params = self.params()
        at_ = np.cumsum([v.size for v in params.values()])[:-1]
        m1, m2 = ({k: x.reshape(params[k].shape).astype(np.float32) for k, x in zip(params, np.split(m, at_))} for m in moments)
        k_all = FILTERS * len(WIDTHS)
        for part in rng.permutation(FOLDS).tolist():
            self.table[:, : figures[part].shape[1]] += figures[part]
            order = rng.permutation(np.flatnonzero(pack.fold == part))
            for low in range(0, len(order), BATCH):
                batch = order[low : low + BATCH]
                grads = {k: np.zeros_like(v) for k, v in params.items()}
                steps: list[tuple[np.ndarray, np.ndarray]] = []
                total = 0.0
                for own, feats, owner in pack.passes(batch):
                    pooled, at = self.pool(feats, owner, len(own), places=True)
                    p = 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.offset, -30, 30)))
                    d = (weight[own] * (p - pack.labels[own]) / len(batch)).astype(np.float32)
                    total += float(d.sum())
                    grads["weights"] += pooled.T @ d
                    back = d[:, None] * self.weights[None, :k_all] * (pooled[:, :k_all] > 0)
                    grads["bias"] += back.sum(0)
                    for i, w in enumerate(self.filters):
                        width = len(w) // DIM
                        cols = slice(i * FILTERS, (i + 1) * FILTERS)
                        row, col = np.nonzero(back[:, cols])
                        if not len(row):
                            continue
                        g, start = back[:, cols][row, col], at[:, cols][row, col]
                        for j in range(width):
                            buckets = feats[start + j]
                            x = self.vectors(buckets)
                            np.add.at(grads[f"f{i}"], (np.arange(j * DIM, (j + 1) * DIM)[None, :], col[:, None]), g[:, None] * x)
                            steps.append((buckets, g[:, None] * w[j * DIM : (j + 1) * DIM, col].T))
                self.offset -= 5 * RATE * total
                step += 1
                for k, v in params.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                    v -= 0.2 * RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-6)
                for buckets, g in steps:
                    for k in range(buckets.shape[1]):
                        np.subtract.at(self.table, buckets[:, k], RATE * g)
            self.table[:, : figures[part].shape[1]] -= figures[part]
        return np.stack([np.concatenate([x.ravel() for x in m.values()]) for m in (m1, m2)]), step

    def calibrate(self, cut: float) -> None:
        """Move the logits so that the scores from ``cut`` on are those from THRESHOLD on."""
        self.offset += logit(THRESHOLD) - logit(cut)


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def best_cut(scores: np.ndarray, labels: np.ndarray, groups: np.ndarray | None = None, clean: float = CLEAN, times: np.ndarray | None = None) -> float:
    """Middle of the widest gap among the cuts (score >= cut is toxic) with the least cost.

    The cost of a group is its share of toxic rows missed and ``clean`` times its
    share of clean rows hit, so that each group counts the same.  ``times`` tells
    how often each row counts.
    """
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    groups = np.zeros(len(s), int) if groups is None else np.unique(groups, return_inverse=True)[1][order]
    n = np.ones(len(s)) if times is None else times[order]
    toxic, all_ = np.bincount(groups, y * n), np.bincount(groups, n)
    miss = np.where(y == 1, n / np.maximum(toxic, 1)[groups], 0)
    hit = np.where(y == 0, n * clean / np.maximum(all_ - toxic, 1)[groups], 0)
    costs = np.r_[0, np.cumsum(miss)] + np.r_[np.cumsum(hit[::-1])[::-1], 0]  # cut before position i
    edges = np.r_[0.0, s, 1.0]
    gaps = edges[1:] - edges[:-1]
    good = (costs <= costs[gaps > 0].min() + 1e-9) & (gaps > 0)
    i = int(np.argmax(np.where(good, gaps, -1)))
    return float((edges[i] + edges[i + 1]) / 2)


@dataclass
class ToxicityModel:
    net: ConvNet
    thresholds: dict[str, float]  # by language, on the scores of the net
    marks: np.ndarray  # hashes of the languages' common words, ascending
    sets: np.ndarray  # which languages (in the order of thresholds) have each

    def languages(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The number of each text's language, -1 where no word tells; of equals the first."""
        if not len(self.marks):
            return np.full(n, -1)
        at = np.minimum(np.searchsorted(self.marks, hashes), len(self.marks) - 1)
        hit = np.flatnonzero(self.marks[at] == hashes)
        counts = np.stack([np.bincount(owner[hit], own[at[hit]], minlength=n) for own in self.sets.T], 1)
        return np.where(counts.max(1) > 0, counts.argmax(1), -1)

    def scores(self, make: Features, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
        """Score and language of each text."""
        hashes, feats, owner = make.hashed(data, offsets)
        n = len(offsets) - 1
        names, known = list(self.thresholds), self.languages(hashes, owner, n)
        moves = np.array([logit(THRESHOLD) - logit(x) for x in self.thresholds.values()] + [0.0])  # the last for -1
        z = self.net.logits(feats, owner, n) + moves[known]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [names[k] if k >= 0 else None for k in known.tolist()]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def common_words(names: list[str], texts: dict[str, int], found: dict[str, dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that at least COMMON of a language's texts have, at most MARKS for each, and which languages have each."""
    top = {name: sorted((-n, h) for h, n in found.get(name, {}).items() if n >= COMMON * texts[name])[:MARKS] for name in names}
    hashes = sorted({h for own in top.values() for _, h in own})
    sets = np.zeros((len(hashes), len(names)), bool)
    place = {h: i for i, h in enumerate(hashes)}
    for k, name in enumerate(names):
        sets[[place[h] for _, h in top[name]], k] = True
    return np.array(hashes, np.uint64), sets


def training_packs(rows: DataFrame, langs: list[str], packs: int) -> DataFrame:
    """pack, data: the rows (lang, toxic, text, key), dealt by a hash; rows that are alike in all don't make a pack longer than twice PACK_BYTES."""
    number = {name: i for i, name in enumerate(langs)}

    def work(batches):
        pack, held, size = None, [], 0
        for b in batches:
            lang, toxic, text, at = (b.column(i) for i in range(4))
            for i in range(len(at)):
                if held and (at[i].as_py() != pack or size >= 2 * PACK_BYTES):
                    yield one(pack, held)
                    held, size = [], 0
                pack, raw = at[i].as_py(), text[i].as_py()
                held.append((number[lang[i].as_py() or ""], toxic[i].as_py(), raw))
                size += len(raw) + ROW_BYTES
        if held:
            yield one(pack, held)

    def one(pack, held):
        return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([Pack.of(held).dump()], pa.binary())], ["pack", "data"])

    dealt = rows.select("lang", "toxic", F.col("text").cast("binary"), F.pmod("key", F.lit(packs)).alias("pack"), "key")
    dealt = dealt.repartition(packs, "pack").sortWithinPartitions("pack", "key")
    return dealt.select("lang", "toxic", "text", "pack").mapInArrow(released(work), "pack long, data binary")


def each_pack(packs: DataFrame, work, schema: str) -> DataFrame:
    """The record batches that ``work`` makes of each pack (its number and itself)."""

    def over(batches):
        for b in batches:
            for i in range(len(b)):
                yield from work(b.column(0)[i].as_py(), Pack.load(b.column(1)[i].as_buffer()))

    return packs.mapInArrow(released(over), schema)


SUMS = "shard int, pack long, rows long, keys binary, parts binary"


def sums_row(shard: int, pack: int, rows: int, keys: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([shard], pa.int32()), pa.array([pack], pa.int64()), pa.array([rows], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([zlib.compress(parts.tobytes(), 1)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["shard", "pack", "rows", "keys", "parts"])


def by_shard(sums: DataFrame, start, add, end, schema: str) -> list:
    """What ``end`` makes (a record batch) of each shard's rows, in order of the packs: none is held but the sum."""

    def work(batches):
        shard = held = None
        for b in batches:
            for i in range(len(b)):
                if b.column(0)[i].as_py() != shard:
                    if shard is not None:
                        yield end(shard, held)
                    shard = b.column(0)[i].as_py()
                    held = start(shard)
                held = add(shard, held, b.column(2)[i].as_py(), b.column(3)[i].as_buffer(), zlib.decompress(b.column(4)[i].as_buffer()))
        if shard is not None:
            yield end(shard, held)

    return sums.repartition(SHARDS + 1, "shard").sortWithinPartitions("shard", "pack", F.crc32("keys"), F.crc32("parts")).mapInArrow(released(work), schema).collect()


def count_figures(packs: DataFrame, rates: np.ndarray) -> tuple[Figures, np.ndarray]:
    """Starting figures from all packs, and the hashes of words that are common in some pack."""

    def counted(pack, data):
        yield sums_row(SHARDS, pack, len(data.labels), data.common(), np.zeros(0))
        for shard, keys, counts in data.counts(rates):
            yield sums_row(shard, pack, len(data.labels), keys, counts)

    def start(shard):
        return np.zeros(0, np.uint64) if shard == SHARDS else np.zeros((len(PREFIXES), SHARD_SIZE, 3, FOLDS))

    def add(shard, held, rows, keys, parts):
        if shard == SHARDS:
            return np.union1d(held, np.frombuffer(keys, np.uint64))
        at = np.frombuffer(keys, np.int32)
        held[at // BUCKETS, at % BUCKETS - shard * SHARD_SIZE] += np.frombuffer(parts, np.float32).reshape(-1, 3, FOLDS)
        return held

    def end(shard, held):
        made = [held.tobytes()] if shard == SHARDS else [zlib.compress(x.tobytes(), 1) for x in starting_figures(held)]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], ["shard", "fold", "data"])

    found = {(r.shard, r.fold): bytes(r.data) for r in by_shard(each_pack(packs, counted, SUMS), start, add, end, "shard int, fold int, data binary")}
    return Figures(found), np.frombuffer(found.pop((SHARDS, 0), b""), np.uint64)


def train_round(packs: DataFrame, net: ConvNet, figures, weight: np.ndarray, moments: np.ndarray, step: int, epoch: int) -> tuple[np.ndarray, int]:
    """Train ``net`` for an epoch in each pack; it becomes the mean of the copies, and each embedding that of the packs that move it."""
    shared = packs.sparkSession.sparkContext.broadcast(pack_net(net))

    def trained(pack, data):
        base = unpack_net(shared.value).part(data.buckets)
        own = base.part(slice(None))
        parts = Figures(figures.value)
        end, last = own.train(data, [parts.of(k, data.buckets) for k in range(FOLDS)], weight[data.langs], moments, step, [11, epoch, pack])
        n, moved = len(data.labels), (own.table - base.table).astype(np.float16)
        yield sums_row(SHARDS, pack, n, np.zeros(0), np.concatenate([[own.offset, last], *(x.ravel() for x in own.params().values()), *end]).astype(np.float64))
        met = np.flatnonzero(moved.any(1))
        for shard, low, high in shards_of(data.buckets[met]):
            yield sums_row(shard, pack, n, data.buckets[met[low:high]].astype(np.int32), moved[met[low:high]])

    def start(shard):
        return [0, 0.0] if shard == SHARDS else [np.zeros(SHARD_SIZE, np.int64), np.zeros((SHARD_SIZE, DIM), np.float32)]

    def add(shard, held, rows, keys, parts):
        if shard == SHARDS:
            return [held[0] + rows, held[1] + rows * np.frombuffer(parts, np.float64)]
        at = np.frombuffer(keys, np.int32) - shard * SHARD_SIZE
        held[0][at] += 1
        held[1][at] += np.frombuffer(parts, np.float16).reshape(-1, DIM)
        return held

    def end(shard, held):
        if shard == SHARDS:
            keys, parts = np.zeros(0, np.int32), held[1] / held[0]
        else:
            at = np.flatnonzero(held[0])
            keys, parts = (at + shard * SHARD_SIZE).astype(np.int32), (held[1][at] / held[0][at, None]).astype(np.float16)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([parts.tobytes()], pa.binary())], ["shard", "keys", "parts"])

    for r in by_shard(each_pack(packs, trained, SUMS), start, add, end, "shard int, keys binary, parts binary"):
        if r.shard < SHARDS:
            net.table[np.frombuffer(r.keys, np.int32)] += np.frombuffer(r.parts, np.float16).reshape(-1, DIM)
            continue
        mean = np.frombuffer(r.parts, np.float64)
        net.offset, step = float(mean[0]), round(mean[1])
        for v, x in zip(net.params().values(), np.split(mean[2:], np.cumsum([v.size for v in net.params().values()]))):
            v[:] = x.reshape(v.shape)
        moments = mean[-moments.size :].reshape(moments.shape)
    shared.destroy()
    return moments, step


def count_scores(packs: DataFrame, net: ConvNet, figures, candidates: np.ndarray) -> list:
    """lang, label, at, n: rows by the bin of their logit with the figures of other folds; with label -1, texts that have each candidate (its hash as a signed number)."""
    shared = packs.sparkSession.sparkContext.broadcast(pack_net(net))

    def work(_, data):
        own = unpack_net(shared.value).part(data.buckets)
        base, z, parts = own.table, np.zeros(len(data.labels)), Figures(figures.value)
        for k in range(FOLDS):
            own.table = base.copy()
            own.table[:, : len(set(PLACES))] += parts.of(k, data.buckets)
            rows = np.flatnonzero(data.fold == k)
            for low in range(0, len(rows), BATCH):
                for texts, feats, owner in data.passes(rows[low : low + BATCH]):
                    z[texts] = own.logits(feats, owner, len(texts))
        bins = np.clip(((z + FAR) * (BINS / 2 / FAR)).astype(int), 0, BINS - 1)
        met, n = np.unique(np.stack([data.langs, data.labels, bins]), axis=1, return_counts=True)
        kept = np.flatnonzero(np.isin(data.hashes, candidates))
        times = data.seen()[:, kept]
        lang, word = np.nonzero(times)
        names = np.unique(data.langs)[lang]
        cols = [np.r_[met[0], names], np.r_[met[1], np.full(len(lang), -1)], np.r_[met[2], data.hashes[kept][word].view(np.int64)], np.r_[n, times[lang, word]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "label", "at", "n"])

    out = each_pack(packs, work, "lang int, label int, at long, n long").groupBy("lang", "label", "at").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return out


def thresholds(net: ConvNet, langs: list[str], counted: list) -> dict[str, float]:
    """Moves the logits by the common threshold; the languages' own ones on the scores then."""
    lang, y, at, n = np.array(sorted((r.lang, r.label, r.at, r.n) for r in counted if r.label >= 0)).T
    z = (at + 0.5) * (2 * FAR / BINS) - FAR
    common = best_cut(sigmoid(z), y, lang, times=n)
    net.calibrate(common)
    moved = sigmoid(z + logit(THRESHOLD) - logit(common))
    cuts = {}
    for k, name in enumerate(langs):
        own = lang == k
        toxic = int((y * n)[own].sum())
        if 0 < toxic < n[own].sum():
            share = toxic / (toxic + SHRINK)
            z_ = share * logit(best_cut(moved[own], y[own], times=n[own])) + (1 - share) * logit(THRESHOLD)
            cuts[name] = float(sigmoid(np.array(z_)))
    return cuts


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> bytes:
    """A packed model from all labelled documents (doc_id, text, lang; doc_id, toxic), each with its whole text.

    Rows with a null label or text are left out of training (not of scoring).  An
    id with several labels counts as toxic if one says so; all rows of an id that
    repeats count.  Figures, rounds of training and thresholds are jobs over packs
    of about PACK_BYTES of text, in the shared folder; the driver gets a row for
    each language and bin of logits, the common words, and the net.  Without
    labels the model gives every text the same low score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string")).where("text IS NOT NULL").join(small_side(labels), "doc_id")
    rows = rows.select("lang", "toxic", "text", F.xxhash64(F.lit("toxicity"), "doc_id", "text").alias("key"))
    stats = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"), F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("size")).orderBy("lang").collect()
    n, hit = sum(r.n for r in stats), sum(r.hit for r in stats)
    none = np.zeros(0, np.uint64), np.zeros((0, 0), bool)
    if not 0 < hit < n:
        net = ConvNet.start()
        net.weights[:] = 0
        net.offset = float(np.log(0.01 / 0.99)) if not hit else 3.0
        return pack_model(ToxicityModel(net, {}, *none))
    rate = min(max(hit / n, 0.01), 0.99)
    langs = sorted(r.lang for r in stats)
    texts = {r.lang: r.n for r in stats}
    hits = {r.lang: r.hit for r in stats}
    rates = np.array([min(max((hits[name] + rate) / (texts[name] + 1), 0.01), 0.99) for name in langs])
    weight = np.array([n / len(langs) / texts[name] for name in langs])  # languages count the same
    with scratch(spark):
        packs = stash(training_packs(rows, langs, -(-sum(r.size for r in stats) // PACK_BYTES)), "toxicity-packs")
        figures, candidates = count_figures(packs, rates)
        shared = spark.sparkContext.broadcast(figures.parts)
        net = ConvNet.start(rate)
        moments, step = np.zeros((2, sum(v.size for v in net.params().values()))), 0
        for epoch in range(EPOCHS):
            moments, step = train_round(packs, net, shared, weight, moments, step, epoch)
        counted = count_scores(packs, net, shared, candidates)
        shared.destroy()
    cuts = thresholds(net, langs, counted)
    found: dict[str, dict[int, int]] = {}
    for r in counted:
        if r.label < 0:
            found.setdefault(langs[r.lang], {})[r.at & (1 << 64) - 1] = r.n
    for shard in range(SHARDS):
        own = np.arange(shard * SHARD_SIZE, (shard + 1) * SHARD_SIZE)
        net.table[own, : len(set(PLACES))] += figures.of(FOLDS, own)
    return pack_model(ToxicityModel(net, cuts, *(common_words(list(cuts), texts, found) if cuts else none)))


def pack_net(n: ConvNet, **more) -> bytes:
    """The net as bytes; embeddings in half precision."""
    out = io.BytesIO()
    parts = {f"f{i}": w for i, w in enumerate(n.filters)}
    np.savez(out, table=n.table.astype(np.float16), bias=n.bias, weights=n.weights, offset=np.array(n.offset), **parts, **more)
    return out.getvalue()


def unpack_net(raw: bytes) -> ConvNet:
    with np.load(io.BytesIO(raw), allow_pickle=False) as x:
        return ConvNet(x["table"], [x[f"f{i}"] for i in range(len(WIDTHS))], x["bias"], x["weights"], float(x["offset"]))


def pack_model(m: ToxicityModel) -> bytes:
    return pack_net(m.net, langs=np.array(list(m.thresholds), str), cuts=np.array(list(m.thresholds.values())), marks=m.marks, sets=m.sets)


def unpack_model(raw: bytes) -> ToxicityModel:
    with np.load(io.BytesIO(raw), allow_pickle=False) as x:
        return ToxicityModel(unpack_net(raw), dict(zip(x["langs"].tolist(), x["cuts"].tolist())), x["marks"], x["sets"])


def score_toxicity(docs: DataFrame, model: bytes, carry=()) -> DataFrame:
    """doc_id, lang, language (that the text tells of, or null), score and toxic (score of THRESHOLD or more) of each text; carried, a struct of the columns named in ``carry``.

    The model comes packed, as plain bytes, so a worker need not have this module
    to read it.  Only the text enters the score.  Null and empty texts get the
    score of a text without words.  Rows with equal or null ids are kept; other
    columns are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        make, model = Features(), unpack_model(shared.value)
        model.net.table = model.net.table.astype(np.float32)
        for b in batches:
            data, offsets = texts_of(b.column(2))
            found = [model.scores(make, data, offsets[low : high + 1]) for low, high in chunks(offsets, 1 << 19)]
            scores = np.concatenate([x for x, _ in found]) if found else np.zeros(0)
            made = [pa.array([x for _, own in found for x in own], pa.string()), pa.array(scores, pa.float64()), pa.array(scores >= THRESHOLD, pa.bool_()), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "lang", "language", "score", "toxic", "carried"][: 2 + len(made)])

    return carrying(docs, ("doc_id long", "lang string", "text string"), carry, work, "doc_id long, lang string, language string, score double, toxic boolean")


def labelled_model(spark, docs: DataFrame, sf_dir: str) -> bytes:
    """The model learnt from labels whose crc32(doc_id) modulo 4 is not 2."""
    labels = table(spark, sf_dir, "labels").where(residue("doc_id", 4) != 2)
    return fit_toxicity(docs, labels)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, labelled_model(spark, docs, sf_dir))
    held = F.coalesce(residue("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "language", "toxic")
