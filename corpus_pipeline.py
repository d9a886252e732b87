"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept.  The first four return the columns
of documents; the last returns the mix: a row for each draw, with its shard,
pass and position.  Decisions hold for each row by its doc_id and text, so rows
that repeat a doc_id are judged by their own text.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm.common import return_memory, scratch, small_side, stash, table, unstash
from prismata.llm.decontaminate import find_copies
from prismata.llm.jaccard_join import jaccard_join
from prismata.llm.mixing import mix_sources, shuffled
from prismata.llm.quality import judge_quality, trusted_ids
from prismata.llm.toxicity import labelled_model, score_toxicity


def _settled(stage):
    """The stage, begun when the executors have given back the heap that the stage before took."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return_memory(spark)
        return stage(spark, docs, sf_dir)

    return begun


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows whose doc_id and text are not among ``gone`` (columns doc_id, key); with ``left_semi`` those that are."""
    side = small_side(gone.select("doc_id", "key").distinct()).alias("gone")
    same = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & F.expr("xxhash64(docs.text)").eqNullSafe(F.col("gone.key"))
    return docs.alias("docs").join(side, same, how)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and the text's key: other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long"), "text", "lang", F.expr("xxhash64(text)").alias("key"))


@_settled
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, with its language's threshold, does not call toxic."""
    found = score_toxicity(docs, labelled_model(spark, docs, sf_dir), carry=docs.columns)
    return found.where(~F.col("toxic")).select("carried.*")


@_settled
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies in the range of trusted text of their language."""
    judged = judge_quality(_keyed(docs), trusted_ids(table(spark, sf_dir, "labels")), carry=["key"])
    gone = stash(judged.where(~F.col("keep")).select("doc_id", "carried.key"), "rejected")
    return _without(docs, gone)


@_settled
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the first by doc_id (null last) and text key; texts without words stay, equal repeated rows once."""
    found = jaccard_join(docs, keyed=True)
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("key") == F.col("lead.key"))
    gone = stash(found.where(F.col("lead").isNotNull() & ~leads).select("doc_id", "key").distinct(), "copies")
    kept = _without(docs, gone)
    twice = stash(_keyed(docs).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated")
    if twice.isEmpty():
        return kept
    return _without(kept, twice).unionByName(_without(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


@_settled
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    found = find_copies(_keyed(docs), table(spark, sf_dir, "benchmark"), carry=["key"])
    gone = stash(found.select("doc_id", "carried.key").distinct(), "contaminated")
    return _without(docs, gone)


@_settled
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: documents' columns, shard, pass and position, a row for each draw."""
    mixed = mix_sources(docs, carry=docs.columns)
    rows = shuffled(mixed)
    return rows.select("carried.*", "shard", "pass", "position")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Trained models and alignments are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has stashed goes once its result is written
            docs = stash(stage(spark, docs or table(spark, sf_dir, "documents"), sf_dir), f"stage-{name}", keep=True)
        if before:
            unstash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
