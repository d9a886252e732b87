"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each of its rows, one bit per language.
The AND of the rows of an n-gram names all languages that contain it.  A text's
score for a language is the share of its n-grams that hit, corrected for the
share that hits by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, released, residue, sample_by, small_batches, table, texts_of

#: Labelled rows that the filters are fitted on, at most in expectation.
TRAIN_ROWS = 6000
#: An n-gram belongs to a language that uses it at least this share as often as the language that uses it most.
SHARE = 0.3
#: Occurrences below which an n-gram is noise.
LEAST_COUNT = 3
HASHES, BITS_PER_GRAM = 4, 12

_KNOWN = 0x3000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def letter_table() -> np.ndarray:
    """Whether each code point below 0x3000 is a letter; those above count as letters if ``str.isalpha`` says so."""
    return np.array([chr(i).isalpha() for i in range(_KNOWN)])


def grams(texts: list[str], letters: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each letter n-gram; runs of other characters are one blank at a word's ends."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(points == 0) - 1
    low = "".join(joined).lower()
    if len(low) == len(joined):
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    else:  # a few characters grow when lowered; those stay
        points = np.frombuffer("".join(c if len(c.lower()) != 1 else c.lower() for c in joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = points < _KNOWN
    letter = letters[np.where(known, points, 0)]
    if not known.all():
        other = np.unique(points[~known])
        alpha = np.array([chr(c).isalpha() for c in other])
        letter[~known] = alpha[np.searchsorted(other, points[~known])]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    between = keep[:-1] & keep[1:] & ~letter[:-1] & ~letter[1:]  # two signs between words: one blank is enough
    keep[1:][between] = False
    s = np.where(letter, points, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    if len(s) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(s) - n + 1
    mid = n // 2
    code = np.zeros(m, np.uint64)
    inner = np.ones(m, bool)
    for i in range(n):
        part = s[i : i + m]
        code += (part + np.uint64(1)) * _MULTIPLIERS[i % 4]
        if 0 < i < n - 1:
            inner &= part > 0
    return mix(code[inner]), owner[mid : mid + m][inner]


@dataclass
class BitSlicedFilter:
    """``rows[i]`` has one bit for each language; ``chance`` is each language's share of false hits."""

    languages: list[str]
    rows: np.ndarray
    chance: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray], hashes: int = HASHES, bits: int = BITS_PER_GRAM) -> BitSlicedFilter:
        languages = sorted(members)
        most = max((len(x) for x in members.values()), default=0)
        size = 1 << max(10, int(most * bits - 1).bit_length() if most else 10)
        rows = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        for i, lang in enumerate(languages):
            for at in cls.places(members[lang], size, hashes):
                rows[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, rows, fill**hashes)

    @staticmethod
    def places(codes: np.ndarray, size: int, hashes: int = HASHES):
        a, b = codes, mix(codes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for i in range(hashes):
            yield ((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as bit words."""
        out = None
        for at in self.places(codes, len(self.rows)):
            out = self.rows[at] if out is None else out & self.rows[at]
        return out

    def decide(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        """Best language of each of ``n`` texts and its share of the corrected hit rates; ``und`` and 0 without n-grams.

        Ties go to the language that comes first; a text of which no n-gram is
        known gets the first language with score 1 / number of languages.
        """
        total = np.bincount(owner, minlength=n)
        k = len(self.languages)
        if not k:
            return ["und"] * n, np.zeros(n)
        masks = self.masks(codes)
        rates = np.zeros((n, k))
        for i in range(k):
            hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            rates[:, i] = np.bincount(owner, hit, minlength=n)
        rates /= np.maximum(total, 1)[:, None]
        rates = np.maximum(0, (rates - self.chance) / np.maximum(1e-9, 1 - self.chance))
        whole = rates.sum(1)
        best = rates.argmax(1)
        score = np.where(whole > 0, rates[np.arange(n), best] / np.where(whole > 0, whole, 1), 1 / k)
        score[total == 0] = 0
        return ["und" if t == 0 else self.languages[b] for t, b in zip(total.tolist(), best.tolist())], score


def fit_filter(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> BitSlicedFilter:
    """Filters from rows of doc_id, text and lang (null lang or text: not used).

    At most ``train_rows`` rows in expectation (or one for each language), as
    many of each language as it has, are counted; whole texts, on the
    executors.  A hash of id and text picks them; equal rows count once.  What
    reaches the driver is one row for each language and n-gram of that bounded
    sample.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    labelled = sample_by(labelled, "lang", train_rows, "lang-id")
    small_batches(labelled.sparkSession)

    def count(batches):
        letters = letter_table()
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for lang in sorted(set(langs.tolist())):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                codes, n = np.unique(grams(own, letters)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = labelled.select(F.col("lang").cast("string"), "text").mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return BitSlicedFilter.build({})
    counts["rate"] = counts["n"] / counts.groupby("lang")["n"].transform("sum")
    most = counts.groupby("gram")["rate"].transform("max")
    kept = counts[(counts["rate"] >= SHARE * most) & (counts["n"] >= min(LEAST_COUNT, counts["n"].max()))]
    return BitSlicedFilter.build({lang: kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64) for lang in counts["lang"].unique()})


def identify(docs: DataFrame, model: BitSlicedFilter) -> DataFrame:
    """doc_id, lang_pred and score of each text.

    Null texts and texts without a letter are ``und`` with score 0.  Rows with
    equal or null ids are kept; other columns are left out.  The filters' size
    is bounded by the n-grams of the fitting sample.
    """
    small_batches(docs.sparkSession)
    # plain values: a worker need not have this module to read them
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.chance))

    def work(batches):
        letters, found = letter_table(), BitSlicedFilter(*shared.value)
        for b in batches:
            data, offsets = texts_of(b.column(1))
            langs, scores = [], []
            for low, high in chunks(offsets):
                texts = [bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in range(low, high)]
                a, s = found.decide(*grams(texts, letters), high - low)
                langs += a
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(work), "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_filter(docs.where(~F.coalesce(residue("doc_id", 3) == 1, F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(residue("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
