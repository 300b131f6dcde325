"""The corpus pipeline: quality, near duplicates, personal data, mixture, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes what one returns to the shared folder, reads
it again as the next one's documents and deletes what the stage wrote on its way.  Rejected documents are taken out by id and a hash of
the text, so that rows that repeat an id are told apart; the list of them, two numbers a row, is broadcast up to
``BROADCAST_BYTES`` as hashed, and joined beyond that; both give equal rows.

Scale: a stage does what its operator does, and reads and writes each document once more.  Texts are shuffled only where the mixture
puts them in order, and by a join of rejected documents beyond the bound of a broadcast.

Edge cases: null ids are documents of their own in all stages; rows that repeat an id but not the text are documents of their own,
those that repeat both are one after the second stage; null and empty texts have no quality and go in the first; an empty table
gives no rows; further columns are carried along, whatever their names, until the last stage, which has digests only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.llm import bpe, common, jaccard, mixing, pii, quality

BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without those that have the ``_id`` and ``_hash`` of a rejected one."""
    rejected = common.materialise(rejected.select("_id", "_hash").distinct(), "rejected")
    side = F.broadcast(rejected) if rejected.count() * ROW_BYTES <= BROADCAST_BYTES else rejected
    same = docs["doc_id"].eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_hash"])
    return docs.join(side, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    trusted = quality.trusted_ids(common.table(spark, sf_dir, "labels"))
    judged = quality.classify(docs.withColumn("_hash", F.xxhash64("text")), trusted, extra=["_hash"])
    return _without(docs, judged.where(~F.col("keep")).select(F.col("doc_id").alias("_id"), "_hash"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (nulls last) and then the smallest hash of the text.

    Texts without shingles are in no group; of them, too, one row of those that repeat an id and a text stays.  Null ids
    are separate documents."""
    named = jaccard.linked_components(docs.withColumn("_hash", F.xxhash64("text")), extra=["_hash"], root_col="_root")
    rows = named.groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.min("_root").alias("_root"), F.count("*").alias("_times"))
    rows = common.materialise(rows, "named")
    grouped = rows.where(F.col("_root").isNotNull())
    first = grouped.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("_f")).select("_f._id", "_f._hash")
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"])
    kept = _without(docs, grouped.join(first, same(grouped, first), "left_anti"))
    again = rows.where((F.col("_times") > 1) & (F.col("_root").isNotNull() | F.col("_id").isNotNull())).select("_id", "_hash")
    if not again.limit(1).count():
        return kept
    here = kept["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(kept["text"]) == again["_hash"])
    repeated = kept.join(again, here, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return kept.join(again, here, "left_anti").unionByName(repeated.select("_row.*"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; lengths follow the text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents that the mix takes, in training order."""
    return mixing.training_order(mixing.curriculum(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each copy and of the text that they decode to."""
    return bpe.digests(bpe.encode_documents(docs, bpe.default_vocabulary()))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("surrogates for personal data", surrogates),
    ("mixture", mixture),
    ("BPE", tokens),
]
#: The first stage's model, the hashing of entities and the tokens can't be expressed in SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.finished(functools.partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(before, "stored_at"):
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
