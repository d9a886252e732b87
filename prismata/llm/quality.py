"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The n-grams are of characters (any code point; digits are one symbol, blanks
another), without a bound on their number: what is counted grows with the
trusted texts.  Counts, continuation counts, context totals and the model of
the next lower order are joined by context and by suffix.

A document is scored by joins with shards of that model.  Documents are put
together in packs; a pack sends each of its distinct n-grams once, to the
shard of its hash, and gets back what the model has of them: the logarithm of
the probability, and as a context that of the weight left to lower orders.
The packs, which went through a shuffle of their own, then add up their texts.

Documents fall into two folds by a hash of the text, and the model that scores
a fold is trained on the trusted texts of the other one: no text is scored by
counts of its own, trusted or not, which would make trusted texts look better
than others as good.

A document's perplexity is compared with quantiles of the trusted documents of
its language; the deviation from the language's mean is scaled by the root of
the length, as short texts scatter more.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, chunks, distinct, mix, release, released, small_batches, small_side, stash, table, texts_of, unstash

ORDER = 4
#: Bytes of text in a pack, or one longer text; n-grams of the model in a shard, about, and bytes of text whose n-grams
#: one task looks up there (more go to several copies of the shard).
PACK_BYTES, SHARD_ROWS, ASKED_BYTES = 8 << 20, 500_000, 256 << 20
#: Bytes of text that one numpy pass works on; its arrays take many times as much.
CHUNK = 1 << 16
#: Text that a counting task takes, at least, where partitions are smaller.
TASK_BYTES = 16 << 20
#: Outer quantiles of the trusted deviations of a language, how many times the way from the median to a quartile the
#: range reaches at least (few documents show no tails), and the slack that widens it.
LOW, HIGH, REACH, SLACK = 0.0005, 0.9995, 6.0, 1.25

_LAGS = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after ORDER - 1 start symbols (0), and the text of each symbol."""
    pad = "\0" * (ORDER - 1)
    joined = "".join(pad + t.replace("\0", "\1") for t in texts)
    s = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    s[(s >= 9) & (s <= 13)] = 32
    s[(s >= 48) & (s <= 57)] = 48
    return s, np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in texts])


def gram_keys(s: np.ndarray, fold: int) -> list[np.ndarray]:
    """Hash of the fold and the n-gram that ends in each symbol, for n = 1 to ORDER; symbols before the first count as start symbols."""
    out, h = [], np.zeros(len(s), np.uint64)
    for lag in range(ORDER):
        h = h.copy()
        h[lag:] += (s[: len(s) - lag] + np.uint64(1)) * _LAGS[lag]
        out.append(mix(h ^ salt(lag + 1, fold)))
    return out


def salt(n: int, fold: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * (2 * n + fold) & (2**64 - 1))


def keys_of(grams: list[str], folds: np.ndarray) -> np.ndarray:
    """The same hashes, of n-grams given as strings."""
    out = np.zeros(len(grams), np.uint64)
    sizes = np.array([len(g) for g in grams])
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        s = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        h = np.zeros(len(own), np.uint64)
        for lag in range(n):
            h += (s[:, n - 1 - lag] + np.uint64(1)) * _LAGS[lag]
        out[own] = mix(h ^ np.where(folds[own] == 1, salt(n, 1), salt(n, 0)))
    return out


class Slots:
    """A hash table of distinct keys (0 stands for none), numbered as they come."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.numbers, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64), 0

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at, mask = keys >> np.uint64(7), np.uint64(len(self.keys) - 1)
        while len(keys):
            slot = at & mask
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.numbers[slot[done]] = numbers[done]
            keys, numbers, at = keys[~done], numbers[~done], at[~done] + np.uint64(1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old, numbers, held = self.keys, self.numbers, self.keys != 0
            size = len(old)
            while 2 * (self.count + len(keys)) > size:
                size *= 4
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int64)
            self._place(old[held], numbers[held])
        self._place(keys, self.count + np.arange(len(keys)))
        self.count += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't held."""
        out = np.full(len(keys), -1)
        at, mask = keys >> np.uint64(7), np.uint64(len(self.keys) - 1)
        slot = at & mask
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.numbers[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            at[left] += np.uint64(1)
            slot = at[left] & mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[slot[hit]]
            left = left[~hit & (there != 0)]
        return out


# the model -------------------------------------------------------------


def with_fold(docs: DataFrame, *cols) -> DataFrame:
    """The columns, fold (0 or 1) and text."""
    text = F.col("text").cast("string")
    return docs.select(*cols, F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(2)).cast("int").alias("fold"), text.alias("text"))


def count_ngrams(trusted: DataFrame) -> DataFrame:
    """fold (that the texts are not of), gram (ORDER code points), n: all n-grams of the highest order; each task sends its own counts once for every PACK_BYTES.

    Small input partitions are put together (without a shuffle), as a task sends
    about as many counts for little text as for much.
    """
    small_batches(trusted.sparkSession)
    total = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    trusted = trusted.coalesce(max(trusted.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))

    class Counts:
        def __init__(self):
            self.slots, self.grams, self.n, self.held = Slots(), [], np.zeros(0, np.int64), 0

        def add(self, texts: list[str]) -> None:
            s, _ = symbols(texts)
            real = np.flatnonzero(s)
            keys = gram_keys(s, 0)[-1][real]
            new = np.flatnonzero(self.slots.find(keys) < 0)
            _, first = np.unique(keys[new], return_index=True)
            at = new[first]
            self.grams.append(s[real[at][:, None] - np.arange(ORDER - 1, -1, -1)])
            self.slots.add(keys[at])
            self.n = np.concatenate([self.n, np.zeros(len(at), np.int64)])
            self.n += np.bincount(self.slots.find(keys), minlength=len(self.n))
            self.held += sum(map(len, texts))

        def rows(self, fold: int):
            texts = np.concatenate(self.grams).tobytes().decode("utf-32-le", "surrogatepass") if self.grams else ""
            for low in range(0, self.slots.count, 20_000):
                part = [texts[ORDER * i : ORDER * (i + 1)] for i in range(low, min(self.slots.count, low + 20_000))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fold), pa.int32()), pa.array(part, pa.string()), pa.array(self.n[low : low + len(part)])], ["fold", "gram", "n"])
            self.__init__()

    def work(batches):
        own = Counts(), Counts()
        for b in batches:
            data, offsets = texts_of(b.column(1))
            folds = b.column(0).to_numpy()
            for low, high in chunks(offsets, CHUNK):
                for fold, counts in enumerate(own):
                    counts.add([bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in range(low, high) if folds[i] != fold])
                    if counts.held >= PACK_BYTES:
                        yield from counts.rows(fold)
        for fold, counts in enumerate(own):
            yield from counts.rows(fold)

    rows = with_fold(trusted).where("text IS NOT NULL").mapInArrow(released(work), "fold int, gram string, n long")
    return rows.groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, x or 0) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train_model(trusted: DataFrame) -> tuple[DataFrame, list[float]]:
    """The models of both folds as a stash of rows key, logp, weight; and for each fold the logarithm of an unknown symbol's probability.

    ``logp`` is that of an n-gram's last symbol after the others; ``weight`` is
    the logarithm of what an n-gram, as a context, leaves to the next lower
    order (either is null where the row isn't of that kind).  A symbol's
    probability is that of the longest n-gram it ends that is known, times the
    weights of the longer contexts that are.
    """
    first = stash(count_ngrams(trusted), "kn-counts")
    levels = [first.select(F.lit(ORDER).alias("k"), "fold", "gram", "n")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: after how many symbols
        levels.append(levels[-1].groupBy("fold", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "fold", "gram", "n"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    whole = stash(whole, "kn-levels")
    found = {r[:2]: discounts(*r[2:]) for r in whole.groupBy("fold", "k").agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).collect()}
    cuts = F.array(*[F.array(*map(F.lit, found.get((fold, k), [0.5, 0.5, 0.5]))) for fold in (0, 1) for k in range(1, ORDER + 1)])
    cut = cuts[F.col("fold") * ORDER + F.col("k") - 1][F.least("n", F.lit(3)).cast("int") - 1]
    own = whole.select("k", "fold", "gram", "n", cut.alias("cut"), F.expr("substring(gram, 1, k - 1)").alias("context"))
    contexts = stash(own.groupBy("k", "fold", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("rest")), "kn-contexts")
    shares = stash(own.join(contexts, ["k", "fold", "context"]).select("k", "fold", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"), "rest"), "kn-shares")
    unknown = [1.0, 1.0]
    for fold, vocabulary, rest in shares.where("k = 1").groupBy("fold").agg(F.count(F.lit(1)), F.max("rest")).collect():
        unknown[fold] = rest / (vocabulary + 1)
    known = [shares.where("k = 1").select("fold", "gram", (F.col("share") + F.array(*map(F.lit, unknown))[F.col("fold")]).alias("p"))]
    for k in range(2, ORDER + 1):
        lower = known[-1].select(F.col("fold").alias("of"), F.col("gram").alias("end"), F.col("p").alias("lower"))
        level = shares.where(F.col("k") == k).join(lower, (F.col("fold") == F.col("of")) & (F.expr(f"substring(gram, 2, {k - 1})") == F.col("end")))
        known.append(stash(level.select("fold", "gram", (F.col("share") + F.col("rest") * F.col("lower")).alias("p")), "kn-known"))
    none = F.lit(None).cast("float")
    rows = contexts.where("k > 1").select("fold", F.col("context").alias("gram"), none.alias("logp"), F.log("rest").cast("float").alias("weight"))
    for level in known:
        rows = rows.unionByName(level.select("fold", "gram", F.log("p").cast("float").alias("logp"), none.alias("weight")))

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(b.column(1).to_pylist(), b.column(0).to_numpy()).view(np.int64)), *b.columns[2:]], ["key", "logp", "weight"])

    model = stash(rows.mapInArrow(released(hashed), "key long, logp float, weight float"), "kn-model")
    for done in (first, whole, contexts, shares, *known[1:]):
        unstash(done)
    return model, [math.log(x) for x in unknown]


# scoring ---------------------------------------------------------------


def packs(docs: DataFrame, carry) -> DataFrame:
    """pack, fold, rows (doc_id, lang and what is carried, of each document), sizes (bytes) and texts (compressed)."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), *([F.struct(*carry).alias("carried")] if carry else [])]
    given = with_fold(docs, F.struct(*cols).alias("row"))
    schema = f"pack long, fold int, rows array<{given.schema['row'].dataType.simpleString()}>, sizes array<int>, texts binary"

    class Pack:
        def __init__(self):
            self.rows, self.sizes, self.raw, self.held = [], [], [], 0

        def made(self, number: int, fold: int):
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([fold], pa.int32()), lists(pa.concat_arrays(self.rows)), lists(pa.array(self.sizes, pa.int32())), pa.array([zstandard.compress(b"".join(self.raw), 3)], pa.binary())]
            self.__init__()
            return pa.RecordBatch.from_arrays(cols, ["pack", "fold", "rows", "sizes", "texts"])

    def work(batches):
        number, own = 0, (Pack(), Pack())
        for b in batches:
            data, offsets = texts_of(b.column(2))
            folds = b.column(1).to_numpy()
            for fold, pack in enumerate(own):
                mine, done = np.flatnonzero(folds == fold), 0
                ends = np.cumsum(np.diff(offsets)[mine])
                while done < len(mine):
                    before = int(ends[done - 1]) if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, before + PACK_BYTES - pack.held, "right")))
                    part = mine[done:upto]
                    pack.rows.append(b.column(0).take(pa.array(part)))
                    pack.sizes += (offsets[part + 1] - offsets[part]).tolist()
                    pack.raw += [data[offsets[i] : offsets[i + 1]].tobytes() for i in part]
                    pack.held += int(ends[upto - 1]) - before
                    done = upto
                    if pack.held >= PACK_BYTES or done < len(mine):
                        yield pack.made(number, fold)
                        number += 1
        for fold, pack in enumerate(own):
            if pack.rows:
                yield pack.made(number, fold)
                number += 1

    return given.mapInArrow(released(work), schema)


def pack_chunks(sizes: np.ndarray, texts: bytes):
    """(first document, number of documents, symbols, text of each symbol) of parts of a pack."""
    raw = zstandard.decompress(texts, max_output_size=max(1, int(sizes.sum())))
    offsets = np.r_[0, np.cumsum(sizes)]
    for low, high in chunks(offsets, CHUNK):
        yield low, high - low, *symbols([raw[offsets[i] : offsets[i + 1]].decode() for i in range(low, high)])


def requests(packed: DataFrame, shards: int) -> DataFrame:
    """pack, check (a sum over the pack's texts), shard and keys: the distinct n-grams of each pack, and their contexts."""

    def work(batches):
        for b in batches:
            for pack, fold, sizes, texts in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                slots = Slots()
                for _, _, s, _ in pack_chunks(np.array(sizes, np.int64), texts):
                    keys, real = gram_keys(s, fold), np.flatnonzero(s)
                    top = keys[-1][real]
                    new = np.flatnonzero(slots.find(top) < 0)
                    at = real[new[np.unique(top[new], return_index=True)[1]]]
                    met = distinct(np.concatenate([x[y] for x in keys[:-1] for y in (at, at - 1)] + [keys[-1][at]]))
                    slots.add(met[slots.find(met) < 0])
                held = np.sort(slots.keys[slots.keys != 0])
                part = shard_of(held, shards)
                order = np.argsort(part, kind="stable")
                held, part = held[order], part[order]
                edges = np.searchsorted(part, np.arange(shards + 1))
                own = np.flatnonzero(edges[:-1] < edges[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), pack)), pa.array(np.full(len(own), zlib.crc32(texts)), pa.int64()), pa.array(own, pa.int32()), pa.array([held[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary())], ["pack", "check", "shard", "keys"])

    return packed.mapInArrow(released(work), "pack long, check long, shard int, keys binary")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


REPLY = pa.schema([("pack", pa.int64()), ("check", pa.int64()), ("keys", pa.binary()), ("logp", pa.binary()), ("weight", pa.binary())])


def look_up(own: pa.Table, rows: pa.Table) -> pa.Table:
    """What a shard (key, logp, weight) has of the keys of each request (pack, check, keys), in batches of about BATCH_BYTES, as the JVM holds one at a time."""
    keys = rows["key"].to_numpy().view(np.uint64)
    slots = Slots()
    slots.add(distinct(keys))
    number = slots.find(keys)
    values = {}
    for name in ("logp", "weight"):
        x = rows[name].to_numpy()
        values[name] = np.full(slots.count, np.nan, np.float32)
        values[name][number[~np.isnan(x)]] = x[~np.isnan(x)]
    out, made, held = [], [], 0
    for pack, check, raw in zip(own["pack"].to_pylist(), own["check"].to_pylist(), own["keys"]):
        wanted = np.frombuffer(raw.as_buffer(), np.uint64)
        at = slots.find(wanted)
        at, wanted = at[at >= 0], wanted[at >= 0]
        made.append((pack, check, *(x.tobytes() for x in (wanted, values["logp"][at], values["weight"][at]))))
        held += sum(map(len, made[-1][2:]))
        if held >= BATCH_BYTES:
            out.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), REPLY.types)], schema=REPLY))
            made, held = [], 0
    if made:
        out.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), REPLY.types)], schema=REPLY))
    release()
    return pa.Table.from_batches(out, REPLY)


def replies(asked: DataFrame, model: DataFrame, shards: int, copies: int) -> DataFrame:
    """pack, check, keys, logp and weight: what the shards of the model have of each pack's n-grams (NaN: nothing).

    ``copies`` of each shard take a part of the packs each.
    """
    # the shard of a key that is signed here: its upper half, as shard_of has it
    high = F.shiftrightunsigned("key", 32)
    rows = model.select(F.shiftrightunsigned(high * shards, 32).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "key", "logp", "weight")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("pack"), F.lit(copies)).cast("int"))

    return asked.groupBy("shard", "copy").cogroup(rows.groupBy("shard", "copy")).applyInArrow(look_up, "pack long, check long, keys binary, logp binary, weight binary")


def score_texts(fold: int, sizes: np.ndarray, texts: bytes, keys: np.ndarray, logp: np.ndarray, weight: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sum of negative logarithms of each text of a pack, from what the model has of its n-grams."""
    slots = Slots()
    slots.add(keys)
    n, nll = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    for first, count, s, owner in pack_chunks(sizes, texts):
        grams, real = gram_keys(s, fold), np.flatnonzero(s)
        logs, left = np.zeros(len(real)), np.arange(len(real))
        for k in range(ORDER, 0, -1):
            at = slots.find(grams[k - 1][real[left]])
            value = np.where(at >= 0, logp[at], np.nan) if len(logp) else np.full(len(at), np.nan)
            known = ~np.isnan(value)
            logs[left[known]] += value[known]
            left = left[~known]
            if k > 1 and len(left) and len(weight):
                at = slots.find(grams[k - 2][real[left] - 1])
                logs[left] += np.nan_to_num(np.where(at >= 0, weight[at], 0))
        logs[left] += unknown
        n[first : first + count] = np.bincount(owner[real], minlength=count)
        nll[first : first + count] = np.bincount(owner[real], -logs, minlength=count)
    return n, nll


def score_documents(docs: DataFrame, model: DataFrame, unknown: list[float], carry=()) -> DataFrame:
    """doc_id, lang, n_symbols and nll (sum of negative logs) of each text, 0 and 0 for null and empty ones; carried, a struct of the columns in ``carry``.

    Packs are numbered by task, so ``docs`` must give the same rows in the same
    order when a task is run again, as a table does; a pack that got another
    one's n-grams is an error.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # three times as many partitions as packs, so that few tasks get several
    packed = packs(docs, carry).repartition(max(docs.sparkSession.sparkContext.defaultParallelism, 3 * -(-total // PACK_BYTES)), "pack")
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-model.count() // SHARD_ROWS))
    told = replies(requests(packed, shards), model, shards, -(-total // (ASKED_BYTES * shards)) or 1)

    def work(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for pack, fold, rows, sizes, texts in zip(*(own[c].combine_chunks() for c in ("pack", "fold", "rows", "sizes", "texts"))):
            mine = told.filter(pa.compute.equal(told["pack"], pack))
            texts, sizes = texts.as_py(), np.array(sizes.as_py(), np.int64)
            if any(c != zlib.crc32(texts) for c in mine["check"].to_pylist()):
                raise RuntimeError("the documents changed while they were scored")
            keys, logp, weight = (np.frombuffer(b"".join(mine[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("logp", np.float32), ("weight", np.float32)))
            n, nll = score_texts(fold.as_py(), sizes, texts, keys, logp, weight, unknown[fold.as_py()])
            flat = rows.values
            out.append(pa.table([flat.field("doc_id"), flat.field("lang"), pa.array(n), pa.array(nll), *([flat.field("carried")] if carry else [])], names=["doc_id", "lang", "n_symbols", "nll", "carried"][: 5 if carry else 4]))
        release()
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("nll", pa.float64()))})

    schema = "doc_id long, lang string, n_symbols long, nll double"
    if carry:
        schema += f", carried {docs.select(F.struct(*carry).alias('c')).schema['c'].dataType.simpleString()}"
    return packed.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(work, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()


def judge_quality(docs: DataFrame, trusted: DataFrame, carry=()) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, deviation, low, high and keep of each document; carried, a struct of the columns in ``carry``.

    ``docs`` has doc_id, text and lang; ``trusted`` has the doc_id of trusted
    documents, whose texts (all of them, whole) train the model and whose
    deviations give each language its range.  A language without trusted
    documents takes the range of all; a null lang is a language of its own.  Texts without
    symbols have a null perplexity and are kept, as is everything if nothing is
    trusted.  Rows with equal or null ids are judged each; other columns are left out.
    """
    side = small_side(trusted.select(F.col("doc_id").cast("long").alias("id")))
    model, unknown = train_model(docs.select(F.col("doc_id").cast("long"), "text").join(side, F.col("doc_id") == F.col("id"), "left_semi"))
    scored = score_documents(docs, model, unknown, carry)
    flagged = scored.join(side, F.col("doc_id") == F.col("id"), "left").withColumn("trusted", F.col("id").isNotNull()).drop("id")
    flagged = stash(flagged, "kn-scores")
    unstash(model)
    good = flagged.where("trusted AND n_symbols > 0")
    means = stash(good.groupBy(F.col("lang").alias("of")).agg(F.sum("nll").alias("of_nll"), F.sum("n_symbols").alias("of_n")), "kn-means")
    whole = means.agg(F.sum("of_nll") / F.sum("of_n")).first()[0] or 0.0

    def deviations(rows: DataFrame) -> DataFrame:
        rows = rows.join(means, rows["lang"].eqNullSafe(means["of"]), "left")
        mean = F.coalesce(F.col("of_nll") / F.col("of_n"), F.lit(whole))
        return rows.withColumn("deviation", F.when(F.col("n_symbols") > 0, (F.col("nll") / F.col("n_symbols") - mean) * F.sqrt("n_symbols"))).drop("of", "of_nll", "of_n")

    cuts = lambda rows: rows.agg(F.percentile_approx("deviation", [LOW, 0.25, 0.5, 0.75, HIGH], 20_000).alias("q"))
    own = deviations(good)
    all_ = cuts(own).first()[0] or [float("-inf"), 0.0, 0.0, 0.0, float("inf")]
    ranges = stash(cuts(own.groupBy("lang")).withColumnRenamed("lang", "of"), "kn-ranges")
    judged = deviations(flagged)
    judged = judged.join(ranges, judged["lang"].eqNullSafe(ranges["of"]), "left")
    q = F.coalesce("q", F.array(*[F.lit(float(x)) for x in all_]))
    low = q[2] - SLACK * F.greatest(q[2] - q[0], REACH * (q[2] - q[1]))
    high = q[2] + SLACK * F.greatest(q[4] - q[2], REACH * (q[3] - q[2]))
    judged = judged.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(F.col("nll") / F.col("n_symbols"))).alias("perplexity"), "deviation", low.alias("low"), high.alias("high"), *(["carried"] if carry else []))
    return judged.withColumn("keep", F.coalesce(F.col("deviation").between(F.col("low"), F.col("high")), F.lit(True)))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
