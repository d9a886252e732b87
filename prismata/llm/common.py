"""Shared plumbing: tables in the shared folder, Arrow text buffers, hashing."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows in one Arrow batch sent to Python; texts may be long.
BATCH_ROWS = 2000
#: Bytes of one, about: what the JVM holds outside its heap for a task, and a worker, follow from it.
BATCH_BYTES = 1 << 20
#: A side of at most so many narrow rows is broadcast, a longer one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that one numpy pass works on (a longer text is a pass of its own).
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, what is stashed within, but for tables that are kept."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            delete(spark, path)


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing else uses; the innermost scope deletes it unless it is kept."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return path


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label, keep)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstash(df: DataFrame) -> None:
    """Delete a table that ``stash`` wrote; nothing may read it later."""
    path = getattr(df, "_stash_path", None)
    if path is None:
        raise ValueError("not a stash")
    delete(df.sparkSession, path)


def released(work):
    """The worker function, which gives freed memory back to the system when a task is done: workers live on."""

    def wrapped(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def return_memory(spark: SparkSession) -> None:
    """Let the executors collect garbage, so that heap which the work so far has grown goes back to the system.

    A collector that is asked shrinks the heap to what lives; by itself it keeps
    what the largest stage took, beside what Python workers of later ones need.
    One small task for each core, a second or so.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows`` and its bytes to about BATCH_BYTES; lower settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "64m").strip().lower()
    unit = held.rstrip("b").lstrip("-0123456789")
    bytes_ = int(held.rstrip("b").removesuffix(unit) or 0) << {"": 0, "k": 10, "m": 20, "g": 30}.get(unit, 40)
    if not 0 < bytes_ <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def small_side(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side (of narrow rows) with a broadcast hint if a count finds few of them, else as it is."""
    return F.broadcast(side) if side.count() <= most else side


def rows_each(counts: list[int], most: int) -> float:
    """Rows of each group at most, at least 1, so that all together are ``most``; what a small one lacks goes to the others."""
    left = most
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) >= left:
            return max(1.0, left / (len(counts) - i))
        left -= n
    return float(max(counts, default=1))


def sample_by(rows: DataFrame, group: str, most: int, salt: str) -> DataFrame:
    """At most ``most`` of the rows in expectation (or one for each group), as many of each group as it has.

    A hash of doc_id and text picks them, so that rows which share an id are
    picked each; of equal ones (doc_id and text) one counts.  The driver gets a
    row for each group.
    """
    rows = rows.withColumn("sample_key", F.xxhash64(F.lit(salt), "doc_id", "text"))
    counts = dict(rows.groupBy(group).agg(F.approx_count_distinct("sample_key", 0.02)).collect())
    each = rows_each(list(counts.values()), most)
    below = [(value, int(min(1.0, each / max(1, n)) * (1 << 40)) if n > each else 1 << 40) for value, n in counts.items()]
    below = F.broadcast(rows.sparkSession.createDataFrame(below, f"sample_group {rows.schema[group].dataType.simpleString()}, sample_below long"))
    kept = rows.join(below, F.col(group).eqNullSafe(F.col("sample_group"))).where(F.pmod("sample_key", F.lit(1 << 40)) < F.col("sample_below"))
    return kept.groupBy("sample_key").agg(*[F.first(c).alias(c) for c in rows.columns if c != "sample_key"]).drop("sample_key")


def carrying(docs: DataFrame, needs, carry, work, schema: str) -> DataFrame:
    """``mapInArrow`` over the needed columns ("name type" each) and, last, a struct of those in ``carry``.

    The struct passes through as column ``carried``, so that its names clash with nothing.
    """
    cols = [F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in needs]
    if not carry:
        return docs.select(*cols).mapInArrow(released(work), schema)
    rows = docs.select(*cols, F.struct(*carry).alias("carried"))
    return rows.mapInArrow(released(work), f"{schema}, carried {rows.schema['carried'].dataType.simpleString()}")


def residue(column: str, by: int):
    """crc32 of an id's decimal text modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """(first, last) row ranges of at most ``size`` bytes each, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of the Latin-1 range lowered."""
    out = ascii_lower()[data]
    if len(out) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[capital] += 0x20
    return out


def space_bytes() -> np.ndarray:
    """True for the bytes 0x20 and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


#: An odd multiplier and its inverse modulo 2**64, and a random word for each byte value.
MULT = 0x9E3779B97F4A7C15
MULT_INVERSE = pow(MULT, -1, 1 << 64)
BYTE_WORDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base & (2**64 - 1), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (wraps modulo 2**64)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending (by sorting, which for many values is much faster than a hash table)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class WordHasher:
    """64-bit hashes of the words of many texts at once, by prefix sums.

    A word is a run of bytes for which ``separators`` is false; ``fold`` maps
    bytes first.  Words never cross texts.
    """

    def __init__(self, separators: np.ndarray, fold: np.ndarray):
        self.sep = separators
        self.fold = fold
        self.values = BYTE_WORDS[fold]
        self.up = powers(MULT, 1)
        self.down = powers(MULT_INVERSE, 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, text number, first byte, byte after) of each word of ``data[offsets[0]:offsets[-1]]``."""
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(data)
        if len(self.up) <= n:
            self.up, self.down = powers(MULT, n), powers(MULT_INVERSE, n)
        word = ~self.sep[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = word[cuts]
        ends[cuts - 1] = word[cuts - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        hashes = mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        return hashes, np.searchsorted(offsets, first, "right") - 1, first, last
