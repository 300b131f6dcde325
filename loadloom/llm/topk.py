"""Exact top-k search by distributed histogram selection.

Every query scores every row, in blocks: the cells of a grid of query blocks and candidate blocks.  Each round adds
up, for each query, a histogram of its scores over all cells, finds the bin that holds the k-th highest score and
divides that bin for the next round, until a bin is one score wide: the threshold.  A last round keeps the
scores above the threshold and, of those equal to it, the smallest ids.  A cell leaves out bins below its own k-th
highest score, and equal scores beyond its own k smallest ids, as they cannot be among the first k of all; so the histograms
are of the scores that can still matter.

Scale: the rows of a cell are bounded by the block sizes, whatever the input; rows between tasks are at most k for a
query and cell; no thresholds or scores reach the driver, which only gets counts and the largest component.  Equal vectors
count as at most k + 1 candidates, and equal queries are searched once.

Edge cases: vectors null, empty, with null or non-finite components or of an uncommon length take no part; each row is a query
or candidate of its own, whether or not its id repeats, and a query's own row alone is not its candidate; null ids come
after all others; fewer than k candidates: all; an empty table: no rows.  Scores that do not fit a long raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .vectors import candidates, matrix, packed, questions, ranked, taking_part, unpack

CANDIDATES, QUERIES, BINS = 2048, 1024, 4096


def floored(m: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(m.astype(np.float64) * scale)


def _cell(k: int, d: int, scale: float, dtype: str, wide: bool, width: int | None, step: int | None):
    """The work of a cell: a round's histogram, or (without a width) the rows that are kept."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_class", "bin", "n"] if width else ["_class", "_row", "_id", "score"]
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            rows, ids, c = unpack(right, d, dtype)
            kind = object if wide else np.float64
            c = c.astype(np.int64).astype(kind).T
            classes, lows = left.column("_class").to_numpy(), left.column("_low").to_numpy()
            q = floored(matrix(left.column("_vec"), d), scale)
            q = np.array([[int(x) for x in r] for r in q], dtype=object) if wide else q
            for a in range(0, len(classes), 256):
                s = q[a : a + 256] @ c
                if wide and max(abs(s.max()), abs(s.min())) >= 2**63:
                    raise OverflowError("a score does not fit a long")
                s = s.astype(np.int64)
                for of, low, row in zip(classes[a : a + 256], lows[a : a + 256], s, strict=True):
                    use = row >= low
                    if width:
                        use &= row - low < width
                    x = row[use]
                    if not len(x):
                        continue
                    if width:
                        if len(x) > k:
                            x = x[x >= low + (np.partition(x, len(x) - k)[len(x) - k] - low) // step * step]
                        bins, n = np.unique((x - low) // step, return_counts=True)
                        out.append((np.full(len(bins), of), bins, n))
                    else:
                        at = np.flatnonzero(use)
                        if len(at) > k:
                            at = at[x >= np.partition(x, len(x) - k)[len(x) - k]]
                        at = at[np.lexsort((rows[at], ids[at], -row[at]))[:k]]
                        out.append((np.full(len(at), of), rows[at], ids[at], row[at]))
        columns = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * len(names)
        return pa.table([pa.array(z.astype(np.int64)) for z in columns], names=names)

    return run


def exact_top_k(df: DataFrame, asking: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is ``asking`` the k highest inner products of floor(scale * x)."""
    given = taking_part(df, asking, id_col, vec_col, True)
    largest = F.max(F.array_max(F.transform("_vec", lambda x: F.abs(x.cast("double")))))
    d, most = given.agg(F.max(F.size("_vec")), largest).first()
    classes, members = questions(given)
    m = classes.count()
    if not m:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    largest = math.ceil(most * scale) + 1
    bound, wide = d * largest * largest, d * largest * largest >= 2**53
    if largest >= 2**62:
        raise OverflowError("a component does not fit a long")
    dtype = "<i4" if largest < 2**31 else "<i8"
    rows = materialise(candidates(given, k), "candidates")
    n, first = rows.count(), k + 1  # the first k + 1 of a class hold the first k of each of its rows
    across, down = math.ceil(n / CANDIDATES), math.ceil(m / QUERIES)
    blocks = packed(rows, d, CANDIDATES, dtype, lambda x: floored(x, scale))
    blocks = materialise(blocks.withColumn("_i", F.pmod(F.xxhash64("_block"), F.lit(across)).cast("int")).drop("_block"), "blocks")
    blocks = blocks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = classes.select("_class", "_vec", F.pmod(F.xxhash64("_class"), F.lit(down)).cast("int").alias("_j"))

    def cells(state: DataFrame, schema: str, width: int | None = None, step: int | None = None) -> DataFrame:
        spread = state.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        return spread.groupBy("_i", "_j").cogroup(blocks.groupBy("_i", "_j")).applyInArrow(_cell(first, d, scale, dtype, wide, width, step), schema)

    width = 2 * bound + 1
    state = asked.withColumn("_low", F.lit(-bound).cast("long")).withColumn("_above", F.lit(0).cast("long"))
    while width > 1:
        step = math.ceil(width / BINS)
        counts = cells(state.select("_class", "_vec", "_low", "_j"), "_class long, bin long, n long", width, step)
        counts = counts.groupBy("_class", "bin").agg(F.sum("n").alias("n"))
        down_from = Window.partitionBy("_class").orderBy(F.desc("bin"))
        counts = counts.withColumn("_to", F.sum("n").over(down_from.rowsBetween(Window.unboundedPreceding, 0)))
        joined = state.join(counts, "_class")
        # The first bin that reaches the score that is sought; the lowest where there are fewer scores.
        pick = F.coalesce(F.max(F.when(F.col("_to") >= first - F.col("_above"), F.col("bin"))), F.min("bin"))
        picked = joined.groupBy("_class").agg(
            F.first("_vec").alias("_vec"), F.first("_j").alias("_j"), F.first("_low").alias("_was"), F.first("_above").alias("_had"), pick.alias("_bin"),
            F.collect_list(F.struct("bin", "n")).alias("_bins"),
        )
        passed = F.aggregate(F.filter("_bins", lambda b: b["bin"] > F.col("_bin")), F.lit(0).cast("long"), lambda t, b: t + b["n"])
        state = picked.select("_class", "_vec", "_j", (F.col("_was") + F.col("_bin") * step).alias("_low"), (F.col("_had") + passed).alias("_above"))
        width = step
    kept = cells(state.select("_class", "_vec", "_low", "_j"), "_class long, _row long, _id long, score long")
    return ranked(kept, classes, members, k, "long")


def op6_exact_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
