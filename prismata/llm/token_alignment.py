"""Cross-tokenizer alignment: how two tokenizers cut the same bytes.

The tokens of B, laid end to end, are a static index of byte intervals.  For
each token of A two bisections (stabbing queries at its first and last byte)
give the tokens of B that it overlaps.  A gap between tokens of A that no token
of B spans is a boundary; boundaries cut both sequences into groups, and every
token of A in a group is linked with every token of B in it.

Corpus-wide counts of linked id pairs come from packs of documents: a pack
sends each distinct pair once, with the number of its documents that hold it,
and gets the totals back, so a pair that all documents hold costs a row a pack.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, released, small_batches, stash, table, texts_of

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text in a pack; pairs in a row of its list.
PACK_BYTES, LIST_PAIRS = 8 << 20, 1 << 14
#: Characters of a text that are encoded at once; links of a group that are written out one by one.
PIECE, GROUP_LINKS = 1 << 16, 1 << 12

#: A space between letters or digits: byte-level pre-tokenizers begin a word there, and no piece holds a space after another character.
_CUT = re.compile(r"(?<=\w) (?=\w)")

#: Fixed value: how byte-level pre-tokenizers with ``use_regex`` cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable ones are their own, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str, tokens: list[bytes]):
    """A faster encoder with the ids of a byte-level BPE file, or None where it would not be the same.

    It is if nothing changes the text before or after, and ids follow the merges:
    then the lowest id of a possible merge is the first merge, as ranks ask for.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    cutter, model = held.get("pre_tokenizer") or {}, held["model"]
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and held.get("normalizer") is None and model["type"] == "BPE"
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if not plain or odd or merged != list(range(256, 256 + len(merged))):
        return None
    ranks = {tokens[i]: i for i in range(256 + len(merged))}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merged) else None


class Aligner:
    """Encodes texts with a byte-level BPE (A, a JSON file) and a piece model (B), and groups their tokens.

    ``encode`` is exact for texts of any length: long ones are encoded in
    pieces, cut at spaces where neither tokenizer can join the sides.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.fast = ranked(path_a, self.bytes_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.bits_a, self.bits_b = ((len(t) - 1).bit_length() for t in (self.bytes_a, self.bytes_b))
        # a token's id as text, with the mark that follows it within a group and at its end
        marked = [(f"{i},", f"{i}|") for i in range(len(self.bytes_a))] + [(f"{i},", f"{i};") for i in range(len(self.bytes_b))]
        self.marked = [x.encode() for two in marked for x in two]

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that, each encoded after a space, give the tokens of the whole."""
        if len(text) <= PIECE or not self.cuts:
            return [text]
        out, first = [], 0
        while len(text) - first > PIECE:
            m = _CUT.search(text, first + PIECE)
            if not m:
                break
            out.append(text[first : m.start()])
            first = m.end()
        return [*out, text[first:]]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B for each text; none if it is null or empty, or either's bytes aren't those of space and text."""
        parts = [self.pieces(t) if t else [] for t in texts]
        flat = [p for own in parts for p in own]
        found_a = self.encode_a([" " + p for p in flat])
        found_b = self.b.encode(flat, num_threads=1) if flat else []
        out, at = [], 0
        for text, own in zip(texts, parts):
            ids_a, ids_b = ([i for ids in found[at : at + len(own)] for i in ids] if len(own) != 1 else found[at] for found in (found_a, found_b))
            at += len(own)
            want = b" " + text.encode() if text else b""
            same = b"".join(map(self.bytes_a.__getitem__, ids_a)) == want == b"".join(map(self.bytes_b.__getitem__, ids_b))
            out.append((ids_a, ids_b) if same else ([], []))
        return out

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray):
        """Group of each token of A, and first and last token of A and of B of each group (last: one past it).

        Both sequences cover the same bytes, those of one text or of several end to end.
        """
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        low = np.searchsorted(ends_b, ends_a - self.size_a[ids_a], "right")  # first of B that ends after A's token begins
        high = np.searchsorted(ends_b - self.size_b[ids_b], ends_a, "left")  # one past the last that begins before it ends
        closes = np.r_[high[:-1] <= low[1:], np.ones(min(1, len(high)), bool)]
        last = np.flatnonzero(closes) + 1
        first = np.r_[np.zeros(min(1, len(last)), np.int64), last[:-1]]
        return np.repeat(np.arange(len(last)), last - first), first, last, low[first], high[last - 1]

    def links(self, doc: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, group: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
        """(document, id pair) keys, ascending and distinct, and how many links each has."""
        first_a, last_a, first_b, last_b = bounds
        width = last_b - first_b
        large = np.flatnonzero((last_a - first_a) * width > GROUP_LINKS)
        each = np.where(np.isin(group, large), 0, width[group])
        before = np.cumsum(each) - each
        at_b = np.repeat(first_b[group] - before, each) + np.arange(each.sum())
        keys = [np.repeat((doc[group] << (self.bits_a + self.bits_b)) | (ids_a << self.bits_b), each) | ids_b[at_b]]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in large:  # repeated ids of a wide group are counted, not written out
            one, n_one = np.unique(ids_a[first_a[g] : last_a[g]], return_counts=True)
            two, n_two = np.unique(ids_b[first_b[g] : last_b[g]], return_counts=True)
            keys.append(((doc[g] << (self.bits_a + self.bits_b)) | (one[:, None] << self.bits_b) | two[None, :]).ravel())
            times.append((n_one[:, None] * n_two[None, :]).ravel())
        return summed(np.concatenate(keys), np.concatenate(times))

    def align(self, texts: list[str | None]):
        """Counts and digest of each text; and number of text, id pair and links of what is linked in it."""
        found = self.encode(texts)
        n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([np.array(x[k], np.int64) for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        group, first_a, last_a, first_b, last_b = self.groups(ids_a, ids_b)
        doc = np.repeat(np.arange(len(texts)), n_a)[first_a]
        n_groups = np.bincount(doc, minlength=len(texts))
        sizes = (last_a - first_a) * (last_b - first_b)
        before = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(n_groups)]]
        keys, times = self.links(doc, ids_a, ids_b, group, (first_a, last_a, first_b, last_b))
        # both sequences group by group, each id with its mark
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends_a[last_a - 1] = ends_b[last_b - 1] = 1
        order[np.arange(len(ids_a)) + first_b[group]] = ids_a * 2 + ends_a
        order[np.arange(len(ids_b)) + np.repeat(last_a, last_b - first_b)] = (len(self.bytes_a) + ids_b) * 2 + ends_b
        digests, at = [], 0
        for n in (n_a + n_b).tolist():
            digests.append(hashlib.sha256(b"".join(map(self.marked.__getitem__, order[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
            at += n
        span = self.bits_a + self.bits_b
        return (n_a, n_b, n_groups, np.diff(before), digests), keys >> span, keys & ((1 << span) - 1), times


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def pack_links(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as differences, then their times, compressed."""
    return pa.compress(np.concatenate([np.diff(pairs, prepend=0), times]).astype("<i8").tobytes(), "zstd", asbytes=True)


def unpack_links(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(raw, 16 * n, "zstd", asbytes=True), "<i8")
    return np.cumsum(both[:n]), both[n:]


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or f"{TOKENIZERS}/byte_bpe_50k.json", b or f"{TOKENIZERS}/piece_bpe_32k.model"


def token_groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, group (from 0), first_byte and end_byte of space + text, a_ids and b_ids: a row for each group.

    ``a`` and ``b`` are the tokenizers' files, on every executor.  Texts that are
    null or empty, or that either tokenizer doesn't give back byte for byte, have no groups.
    """
    small_batches(docs.sparkSession)
    paths = _paths(a, b)

    def work(batches):
        aligner = Aligner(*paths)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids_a, ids_b = (np.array(x, np.int64) for x in aligner.encode([text.as_py()])[0])
                _, first_a, last_a, first_b, last_b = aligner.groups(ids_a, ids_b)
                ends = np.cumsum(aligner.size_a[ids_a])[last_a - 1]
                for k in range(0, len(ends), LIST_PAIRS):
                    g = slice(k, k + LIST_PAIRS)
                    lists = [
                        pa.ListArray.from_arrays(pa.array(np.r_[f[g], u[g][-1:]] - f[k], pa.int32()), pa.array(ids[f[k] : u[g][-1]], pa.int32()))
                        for f, u, ids in ((first_a, last_a, ids_a), (first_b, last_b, ids_b))
                    ]
                    n = len(ends[g])
                    starts = np.r_[ends[k - 1] if k else 0, ends[g][:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(np.arange(k, k + n)), pa.array(starts), pa.array(ends[g]), *lists], ["doc_id", "group", "first_byte", "end_byte", "a_ids", "b_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(released(work), "doc_id long, group long, first_byte long, end_byte long, a_ids array<int>, b_ids array<int>")


def _align_packs(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """pack and either ``doc``, a document's figures and links, or ``pairs`` with ``docs``, part of the pack's distinct pairs."""
    small_batches(docs.sparkSession)
    fields = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in ALIGNED.split(", ")] + [("n_pairs", pa.int64()), ("links", pa.binary())])
    names = ["pack", "doc", "pairs", "docs"]
    longs = pa.list_(pa.int64())

    def lists(pack: int, held: list[np.ndarray]):
        pairs, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        for k in range(0, len(pairs), LIST_PAIRS):
            part = slice(k, k + LIST_PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.nulls(1, fields), pa.array([pairs[part]], longs), pa.array([n[part]], longs)], names)

    def work(batches):
        aligner = Aligner(*paths)
        pack, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            _, offsets = texts_of(batch.column(1))
            for first, last in chunks(offsets):
                if size and size + offsets[last] - offsets[first] > PACK_BYTES:
                    yield from lists(pack, held)
                    pack, size, held = pack + 1, 0, []
                figures, at, pairs, times = aligner.align(batch.column(1).slice(first, last - first).to_pylist())
                bounds = np.searchsorted(at, np.arange(last - first + 1))
                links = [pack_links(pairs[i:j], times[i:j]) if j > i else b"" for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [batch.column(0).slice(first, last - first), *map(pa.array, figures), pa.array(np.diff(bounds)), pa.array(links, pa.binary())]
                rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], fields=list(fields))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pack, np.int64)), rows, pa.nulls(n, longs), pa.nulls(n, longs)], names)
                held.append(pairs)
                size += int(offsets[last] - offsets[first])
        yield from lists(pack, held)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(released(work), f"pack long, doc struct<{ALIGNED.replace(' ', ':').replace(',:', ',')},n_pairs:long,links:binary>, pairs array<long>, docs array<long>")


def _bits(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return (SentencePieceProcessor(model_file=path_b).get_piece_size() - 1).bit_length()


def pair_counts(packs: DataFrame, bits_b: int) -> DataFrame:
    """pair, n_docs (documents that hold it linked) and best (no other pair of its id of A is in more)."""
    counts = packs.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    counts = stash(counts, "pair-counts")
    top = counts.groupBy(F.shiftright("pair", bits_b).alias("a")).agg(F.max("n_docs").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(top), F.shiftright("pair", bits_b) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each document.

    A reads a space and the text, B the text, to which it adds the space.  A
    link's count is the number of documents that hold its id pair linked;
    ``n_best`` are the links whose count no other pair of their id of A exceeds.
    Texts that are null or empty, or that either tokenizer doesn't give back byte
    for byte, have no tokens: zeros and an empty digest.  Repeated rows count
    each; rows without an id stay; other columns are left out; an empty table
    gives none.  ``a`` and ``b`` are the tokenizers' files, on every executor.
    """
    paths = _paths(a, b)
    packs = stash(_align_packs(docs, paths), "aligned")
    asks = packs.where("pairs IS NOT NULL").select(F.col("pack").alias("of"), F.explode("pairs").alias("pair"))
    answers = asks.join(pair_counts(packs, _bits(paths[1])), "pair").select("of", "pair", "n_docs", "best")
    rows = packs.where("doc IS NOT NULL").select("pack", "doc.*")

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = answers["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, counts, best = pairs[order], answers["n_docs"].to_numpy()[order], answers["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for n, raw in zip(rows["n_pairs"].to_pylist(), rows["links"]):
            if not n:
                n_best.append(0)
                count_sum.append(0)
                continue
            own, times = unpack_links(raw.as_py(), n)
            at = np.searchsorted(pairs, own)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * counts[at]).sum()))
        out = rows.drop_columns(["pack", "n_pairs", "links"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return rows.groupBy("pack").cogroup(answers.groupBy("of")).applyInArrow(score, ALIGNED + ", n_best long, count_sum long")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
