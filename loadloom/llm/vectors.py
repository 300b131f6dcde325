"""What the two vector searches share: which vectors take part, equal vectors, and scoring in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: Stands for a null id, so that it comes after all others.
NO_ID = (1 << 63) - 1
#: Rows of equal queries that share a task.
MEMBERS = 4096


def taking_part(df: DataFrame, asking: Column, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """``_row`` (a number of its own for each row), ``_id``, ``_vec`` and ``_asks`` of the rows that take part, written: no null
    vector, no null or non-finite component, of the most common length (the longer of two), and not all zero unless ``zero``."""
    v = F.col("_vec")
    df = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(vec_col).alias("_vec"), F.coalesce(asking, F.lit(False)).alias("_asks"))
    df = df.where(v.isNotNull() & (F.size(v) > 0)).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    df = df if zero else df.where(F.exists(v, lambda x: x != 0))
    df = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    # One row a length reaches the driver.
    found = df.groupBy(F.size("_vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return df.where(F.size("_vec") == (found[0].d if found else 0))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """``_row``, ``_id`` and ``_vec``: of equal vectors the k + 1 with the smallest ids.  No others can be among the first k
    of any query, itself one of the rows, so a vector that a third of all rows have weighs no more than k + 1 others."""
    first = Window.partitionBy("_vec").orderBy("_id", "_row")
    return rows.select("_row", "_id", "_vec").withColumn("_of", F.row_number().over(first)).where(F.col("_of") <= k + 1).drop("_of")


def questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors as ``_class`` and ``_vec``, and the rows that ask them as ``_class``, ``_row``, ``_id`` and ``_part``;
    a class has ``_parts`` parts of about ``MEMBERS`` rows."""
    asked = rows.where("_asks")
    classes = materialise(asked.groupBy("_vec").agg(F.min("_row").alias("_class"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts")), "queries")
    members = asked.join(classes, "_vec").select("_class", "_row", "_id", F.pmod(F.xxhash64("_row"), "_parts").cast("int").alias("_part"))
    return classes, members


def ranked(found: DataFrame, classes: DataFrame, members: DataFrame, k: int, score: str) -> DataFrame:
    """The first k for each row that asks, from the first k + 1 (or more) of its class, itself left out: ``found`` has
    ``_class``, ``_row``, ``_id`` and ``score``."""
    of_class = Window.partitionBy("_class").orderBy(F.desc("score"), "_id", "_row")
    best = found.withColumn("_rank", F.row_number().over(of_class)).where(F.col("_rank") <= k + 1)
    lists = best.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct("_rank", "_row", "_id", "score"))).alias("_found"))
    lists = lists.join(classes.select("_class", "_parts"), "_class").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = members.withColumnsRenamed({"_row": "_asker", "_id": "_query"}).join(lists, ["_class", "_part"])
    others = F.slice(F.filter("_found", lambda x: x["_row"] != F.col("_asker")), 1, k)
    out = met.select("_query", F.posexplode(others).alias("_at", "x"))
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(known(F.col("_query")).alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"), known(F.col("x._id")).alias("vec_id"), F.col("x.score").cast(score).alias("score"))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A column of lists of length d without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def packed(df: DataFrame, d: int, rows: int, dtype: str, change) -> DataFrame:
    """Rows of ``_row``, ``_id`` and ``_vec`` as blocks of at most ``rows`` vectors: ``_block``, ``_rows``, ``_ids`` and ``_mat``.

    Blocks are cut where the rows are read; nothing is shuffled, and equal ids or vectors weigh no more than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                longs = [pa.array([part.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for i in (0, 1)]
                mat = change(matrix(part.column(2), d)).astype(dtype)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *longs, pa.array([mat.tobytes()], pa.binary())], names=["_block", "_rows", "_ids", "_mat"])
                number += 1

    return arrow_map(df.select("_row", "_id", "_vec"), run, "_block long, _rows binary, _ids binary, _mat binary")


def unpack(block: pa.Table, d: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(b"".join(block.column(c).to_pylist()), "<i8") for c in ("_rows", "_ids"))
    return rows, ids, np.frombuffer(b"".join(block.column("_mat").to_pylist()), dtype).reshape(-1, d)
