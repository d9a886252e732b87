"""License notices in texts, exact phrases and edited notices.

Notices are matched with up to ``k`` edits: the pattern is cut into ``k + 1``
pieces, so one piece must occur unchanged (pigeonhole); an Aho-Corasick
automaton finds the pieces of all notices in one pass, and the ``regex``
library verifies the text around each find with bounded errors and gives the
span and the number of edits.  Edits may fall anywhere but on what tells a
license from others (``mit`` in "released under the mit license"): this must
stand unchanged in the span, or within ``k`` characters of it.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, chunks, released, small_batches, table, texts_of

#: Phrases whose words must stand consecutively (fixed by the contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses that are named alone, by word, and what may follow the name of a Creative Commons license.
NAMED = ("agpl", "apache", "bsd", "gpl", "isc", "lgpl", "mit", "mpl")
CC_PARTS = {"sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
CC_LICENSES = ("", "sa", "nd", "nc", "nc-sa", "nc-nd")


def word(*words: str, unless: tuple[str, ...] = ()) -> str:
    """A pattern of words that stand as such, apart by spaces or dashes, and aren't followed by one of ``unless``."""
    after = rf"(?![-\s]*(?:{'|'.join(unless)}))" if unless else ""
    return r"(?<![0-9a-z])" + r"[-\s]+".join(words) + r"(?![0-9a-z])" + after


def _notices() -> list[tuple[str, str, str]]:
    """Short notices: lower-case text, label, and what tells the license from its neighbours, which no edit may touch."""
    out = [(f"{verb} under the {x} license", x, word(x)) for x in NAMED for verb in ("licensed", "released")]
    for x in CC_LICENSES:
        short, long = x.split("-") if x else [], [CC_PARTS[p] for p in x.split("-")] if x else []
        label = "-".join(["cc-by", *short])
        out.append((f"licensed under {label.replace('cc-', 'cc ')}", label, word("by", *short, unless=tuple(CC_PARTS))))
        out.append(("-".join(["creative commons attribution", *long]), label, word("attribution", *long, unless=("non", "share", "no"))))
    return out + [
        ("apache license version 2.0", "apache", word("apache")),
        ("this work is licensed under the gnu general public license", "gpl", word("gnu", "general")),
        ("gnu general public license version", "gpl", word("gnu", "general")),
        ("gnu lesser general public license", "lgpl", word("lesser")),
        ("gnu affero general public license", "agpl", word("affero")),
        ("mozilla public license", "mpl", word("mozilla")),
        ("redistribution and use in source and binary forms", "bsd", ""),
        ("permission is hereby granted, free of charge", "mit", ""),
        ("permission to use, copy, modify, and/or distribute this software", "isc", ""),
        ("spdx-license-identifier", "spdx", word("spdx")),
        ("dedicated to the public domain", "public-domain", word("public")),
        ("all rights reserved", "proprietary", ""),
    ]


NOTICES = _notices()

#: Characters of a notice for each piece: pieces this long rarely occur by chance.
PIECE = 9


def allowed_edits(notice: str) -> int:
    return max(1, len(notice) // PIECE - 1)


#: Bytes of words: digits, lower-case letters (after folding) and all of non-ASCII characters.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def _phrase_pattern(phrase: str) -> re.Pattern:
    word, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
    body = gap.join(re.escape(w.encode()) for w in phrase.split())
    return re.compile(rb"(?<!" + word + rb")(?=" + body + rb"(?!" + word + rb"))" + re.escape(phrase.split()[0].encode()))


def split_pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class NoticeFinder:
    """Finds notices with bounded edits (insertions, deletions, substitutions of characters)."""

    def __init__(self, notices=NOTICES):
        self.notices = [(text, label, allowed_edits(text)) for text, label, _ in notices]
        self.telling = [re.compile(tells) for _, _, tells in notices]
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(text, special_only=True)}){{e<={k}}}") for text, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        where: dict[str, list] = {}
        for number, (text, _, k) in enumerate(self.notices):
            for piece, offset in split_pieces(text, k):
                where.setdefault(piece, []).append((number, offset))
        for piece, uses in where.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per notice, the merged ranges of the text in which a match may lie.

        A match with ``e`` edits leaves at least ``k + 1 - e`` pieces unchanged, so one find is enough.
        """
        found: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for number, offset in uses:
                notice, _, k = self.notices[number]
                start = end + 1 - size - offset
                low, high = max(0, start - k), min(len(text), start + len(notice) + k)
                runs = found.setdefault(number, [])
                if runs and low <= runs[-1][1]:
                    runs[-1] = [min(runs[-1][0], low), max(runs[-1][1], high)]
                else:
                    runs.append([low, high])
        return {n: [(a, b) for a, b in runs] for n, runs in found.items()}

    def told(self, number: int, text: str, start: int, end: int) -> bool:
        """Whether the span holds what tells the notice's license; names that go on behind it are looked at whole."""
        k = self.notices[number][2]
        low = max(0, start - k - 1)
        return any(low + m.start() >= start - k and low + m.end() <= end + k for m in self.telling[number].finditer(text[low : end + k + 20]))

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(label, start, end, 1 - edits / length) of each verified notice in lower-case text, in order of start."""
        out = []
        for number, ranges in self.windows(text).items():
            notice, label, _ = self.notices[number]
            for low, high in ranges:
                at = low
                while m := self.patterns[number].search(text, at, high):
                    if self.told(number, text, *m.span()):
                        out.append((label, *m.span(), 1 - sum(m.fuzzy_counts) / len(notice)))
                        at = max(m.end(), m.start() + 1)
                    else:
                        at = m.start() + 1
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


class Scanner:
    """Words, exact phrases and fuzzy notices of a batch of texts."""

    def __init__(self):
        self.fold = ascii_lower()
        self.phrases = [(label, _phrase_pattern(p)) for p, label in PHRASES.items()]
        self.finder = NoticeFinder()

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """One tuple per text: words, base places, first, last, base labels, labels, score, spans."""
        data = self.fold[data[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        word = _WORD_BYTE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        begins[cuts] = word[cuts]
        starts = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(starts, offsets))
        raw = data.tobytes()
        for i, n in enumerate(counts.tolist()):
            low, high = int(offsets[i]), int(offsets[i + 1])
            text = raw[low:high]
            places, base = [], set()
            for label, pattern in self.phrases:
                for m in pattern.finditer(text):
                    places.append(low + m.start())
                    base.add(label)
            spans = self.finder.find(text.decode())
            first = last = None
            if places:
                head = np.searchsorted(starts, low)
                first, last = (int(np.searchsorted(starts, x) - head) for x in (min(places), max(places)))
            labels = base | {s[0] for s in spans}
            score = 1.0 if base else max((s[3] for s in spans), default=0.0)
            yield n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each text.

    Spans are code point ranges of verified notices.  The score is 1 for an exact
    phrase, else the similarity of the best notice, 0 for none.  A null text counts
    as empty: no words, no labels (empty strings).  Rows with equal or null ids
    are kept; other columns are left out.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]

    def work(batches):
        scan = Scanner()
        for b in batches:
            data, offsets = texts_of(b.column(1))
            rows = [r for low, high in chunks(offsets) for r in scan(data, offsets[low : high + 1])]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,similarity:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(work), schema)


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
