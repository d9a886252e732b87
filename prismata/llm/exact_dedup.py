"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole.

Each level looks only at rows that share the former level's key with another
row: the shared keys are held as a bit set of fixed size, which is broadcast,
so texts are never shuffled and what is broadcast doesn't grow with the data.
Where keys collide in the bit set a row goes on to the next level without need;
the last level decides by SHA-256 alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the prefix; bits of the sets of lengths (exact below 2**24 bytes) and of prefixes, 64 in a broadcast row.
PREFIX, LENGTH_BITS, PREFIX_BITS = 64, 24, 26
#: Groups of more rows than this are joined by broadcast: there is at most one of them in so many rows.
HOT_ROWS = 1 << 20


def folded(text: Column) -> Column:
    """The text with A to Z lowered, and no other letter."""
    return F.translate(text, UPPER, LOWER)


def shared_keys(keys: DataFrame, bits: int) -> DataFrame:
    """word, set: the bit set (2**bits long) of the long ``key`` values that at least two rows have."""
    at = F.pmod("key", F.lit(1 << bits))
    twice = keys.groupBy("key").count().where("count > 1")
    return twice.select(F.floor(at / 64).alias("word"), F.expr("shiftleft(1L, cast(pmod(key, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))


def sieved(rows: DataFrame, key: Column, sieve: DataFrame, bits: int) -> DataFrame:
    """The rows with ``shared``: whether the bit set has their key."""
    at = F.pmod(key, F.lit(1 << bits))
    held = F.broadcast(sieve.select(F.col("word").alias("sieve_word"), F.col("set").alias("sieve_set")))
    found = rows.withColumn("sieve_at", at).join(held, F.floor(F.col("sieve_at") / 64) == F.col("sieve_word"), "left")
    shared = F.expr("coalesce(shiftright(sieve_set, cast(pmod(sieve_at, 64) as int)) & 1L, 0L) = 1")
    return found.withColumn("shared", shared).drop("sieve_at", "sieve_word", "sieve_set")


def exact_dedup(docs: DataFrame, carry=(), digests: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, n_bytes, text_sha256: a row for each document, dropped ones too.

    Texts are equal when they are identical after A to Z are lowered; null is the
    empty text.  Of equal texts one row stays, that with the largest doc_id (a
    null id is less than any; ties of the id go by a hash of the text as it is
    and then to any one row), and ``keep_id`` is its doc_id.  ``text_sha256`` is
    of the lowered text in UTF-8, null where an earlier level found the text to
    be the only one, unless ``digests`` asks for all of them.  The columns in
    ``carry`` pass through as a struct ``carried``; others are left out, so names
    can't clash.  An empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.octet_length(text).cast("long")
    prefix = F.xxhash64(length, folded(F.substring(text, 1, PREFIX)))

    # level 1: lengths that at least two rows have
    sieve = stash(shared_keys(docs.select(length.alias("key")), LENGTH_BITS), "lengths")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    length, prefix = F.octet_length("text").cast("long"), F.xxhash64(F.octet_length("text").cast("long"), folded(F.substring("text", 1, PREFIX)))
    # level 2: of these rows, (length, prefix) pairs that at least two have
    heads = sieved(rows.select("text"), length, sieve, LENGTH_BITS).where("shared").select(prefix.alias("key"))
    sieve = stash(shared_keys(heads, PREFIX_BITS), "prefixes")
    # level 3: of these, the whole text
    found = sieved(rows, prefix, sieve, PREFIX_BITS)
    digest = F.sha2(folded(F.col("text")), 256)
    found = found.select(
        "doc_id", length.alias("n_bytes"), F.struct("doc_id", F.xxhash64("text").alias("own"), F.monotonically_increasing_id().alias("row")).alias("rank"),
        "shared", (digest if digests else F.when(F.col("shared"), digest)).alias("text_sha256"), *(["carried"] if carry else []),
    )
    found = stash(found, "digests")
    groups = found.where("shared").groupBy(F.col("text_sha256").alias("of")).agg(F.max("rank").alias("lead"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = stash(groups, "groups")
    hot, cold = groups.where(F.col("group_size") > hot_rows), groups.where(F.col("group_size") <= hot_rows)
    same = F.col("text_sha256") == F.col("of")
    alone = [F.lit(None).cast(groups.schema["lead"].dataType).alias("lead"), F.lit(1).cast("long").alias("group_size")]
    rest = found.where("shared").join(F.broadcast(hot.select("of")), same, "left_anti")
    parts = [
        found.where("NOT shared").select("*", *alone),
        found.where("shared").join(F.broadcast(hot), same).drop("of"),
        rest.join(cold, same, "left").drop("of").withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    leads = F.col("lead").isNull() | (F.col("lead.own").eqNullSafe(F.col("rank.own")) & F.col("lead.row").eqNullSafe(F.col("rank.row")) & F.col("lead.doc_id").eqNullSafe(F.col("rank.doc_id")))
    keep = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return every.select("doc_id", keep.alias("keep_id"), "group_size", leads.alias("kept"), "n_bytes", "text_sha256", *(["carried"] if carry else []))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_dedup(docs, carry=docs.columns).where("kept").select("carried.*")


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g USING (x)
"""
