"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the cell of width ``WIDTH`` in which ``PROJECTIONS`` Gaussian projections
of it fall.  For largest inner products, vectors are scaled by the greatest norm and completed to unit length by one
more component, which a query has as 0: then the nearest by distance have the largest products.  Of a vector at the distance
d, the squared distances of the projections from the query's add up to d^2 times a chi-square variable; so the less the squared distance of a cell's middle from the query's projections, the greater its chance to hold a near vector.  A query visits its own and the perturbed
cells in that order, in each segment all that a vector as near as its k-th so far would fall into, but for a part ``MISSED`` of the cases in
each table.  Segments are visited in rounds, each of ``GROWTH`` times as many as all before, so that a k-th from some of them bounds what others
look at and return.  Candidates of all tables are merged and ranked by their exact inner products in double precision.

Scale: rows are indexed in segments of at most ``SEGMENT`` rows, cut where they are read; every row is indexed and nothing is fitted on
a sample, only the greatest norm is collected.  A task has one segment and at most ``QUERIES`` queries, whatever buckets are hot, and
returns at most k + 1 rows a query, none farther than its (k + 1)-th of the rounds before.  Of rows in no particular order, some GROWTH * k then
come back from each round: rows between tasks grow with the queries and the logarithm of the number of segments, not with both numbers.  Equal
vectors count as at most k + 1 rows, and equal queries are searched once.  How many cells are visited follows from the data: few where neighbours are much nearer than the rest.  Of vectors without any such structure, on the
contrary, half are scored, see the README.

Edge cases: vectors null, empty, zero, with null or non-finite components or of an uncommon length take no part; each row is a
query or candidate of its own, whether or not its id repeats, and a query's own row alone is not its candidate; null ids come
after all others; fewer than k candidates: all; an empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .vectors import candidates, matrix, packed, questions, ranked, taking_part, unpack

TABLES, PROJECTIONS, WIDTH, SEED = 2, 24, 1.0, 20
SEGMENT, QUERIES, STEP, GROWTH = 4096, 1024, 256, 3
MISSED = 0.33
#: Fixed value: the quantile of the standard normal distribution that leaves out MISSED.
Z_MISSED = 0.4399


def chi_square_bound(p: int) -> float:
    """What a chi-square variable of p degrees of freedom exceeds in a part MISSED of the cases (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + Z_MISSED * math.sqrt(2 / (9 * p))) ** 3


def hashes(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((TABLES, d + 1, PROJECTIONS)), rng.uniform(0, WIDTH, (TABLES, PROJECTIONS))


def cells_of(m: np.ndarray, norm: float) -> list[np.ndarray]:
    """For each table the cell of each row."""
    a, b = hashes(m.shape[1])
    x = m / norm
    x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])
    return [np.floor((x @ a[t] + b[t]) / WIDTH).astype(np.float32) for t in range(TABLES)]


def projected(q: np.ndarray) -> list[np.ndarray]:
    """For each table the projections of query vectors, in widths of cells."""
    a, b = hashes(q.shape[1])
    x = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])
    return [((x @ a[t] + b[t]) / WIDTH).astype(np.float32) for t in range(TABLES)]


def costs(cells: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of some queries' projections from the middle of each row's cell: the less, the likelier a near vector."""
    middle = cells + np.float32(0.5)
    out = (middle * middle).sum(1)[None, :] - 2 * (q @ middle.T) + (q * q).sum(1)[:, None]
    return np.maximum(out, 0) * np.float32(WIDTH * WIDTH)


def reach(squared: np.ndarray) -> np.ndarray:
    """How far the middle of the cell of a vector at a distance is in a part 1 - MISSED of the cases; a cell's inside adds its variance."""
    return squared * chi_square_bound(PROJECTIONS) + PROJECTIONS * WIDTH * WIDTH / 12


def _search(k: int, d: int, norm: float, dtype: str):
    """The work of a segment and some queries: of the rows visited the first k whose score is at least the query's ``_least``, the
    k-th of all segments so far; a last row has no class, but the pairs that were scored as ``_visited``.

    Queries go on, in steps, until the cells are farther away than vectors as near as that, or as the k-th of this segment so far, would be."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        visited = 0
        if left.num_rows and right.num_rows:
            rows, ids, c = unpack(right, d, dtype)
            c = c.astype(np.float64)
            cells = cells_of(c, norm)
            classes, leasts = left.column("_class").to_numpy(), left.column("_least").to_numpy(zero_copy_only=False)
            q = matrix(left.column("_vec"), d).astype(np.float64)
            lengths = np.linalg.norm(q, axis=1)
            places = projected(q)
            for a in range(0, len(q), 64):
                every = [costs(cells[t], places[t][a : a + 64]) for t in range(TABLES)]
                for i, x in enumerate(q[a : a + 64]):
                    least, scale = leasts[a + i], 2 / (lengths[a + i] * norm)
                    far = lambda score: reach(max(0.0, 2 - scale * score))  # noqa: B023, E731
                    cost = np.minimum.reduce([e[i] for e in every])
                    limit = far(least)
                    order = np.flatnonzero(cost <= limit)
                    order = order[np.argsort(cost[order], kind="stable")]
                    at, exact = order[:0], np.empty(0)
                    while len(order) and cost[order[0]] <= limit:
                        # Products are summed alike for all rows, so that equal vectors have equal scores.
                        exact = np.concatenate([exact, (c[order[:STEP]] * x).sum(1)])
                        at, order = np.concatenate([at, order[:STEP]]), order[STEP:]
                        if len(exact) >= k:
                            limit = min(limit, far(np.partition(exact, len(exact) - k)[len(exact) - k]))
                    n = len(at)
                    visited += n
                    best = exact >= (max(least, np.partition(exact, n - k)[n - k]) if n > k else least)
                    at, exact = at[best], exact[best]
                    first = np.lexsort((rows[at], ids[at], -exact))[:k]
                    out.append((np.full(len(first), classes[a + i]), rows[at][first], ids[at][first], exact[first]))
        kinds = {"_class": pa.int64(), "_row": pa.int64(), "_id": pa.int64(), "score": pa.float64()}
        columns = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0)] * 4
        n = len(columns[0])
        found = [pa.concat_arrays([pa.array(z.astype(kind.to_pandas_dtype())), pa.nulls(1, kind)]) for z, kind in zip(columns, kinds.values(), strict=True)]
        return pa.table([*found, pa.array([*[0] * n, visited], pa.int64())], names=[*kinds, "_visited"])

    return run


def nearest(df: DataFrame, asking: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is ``asking`` the k largest inner products found."""
    return search(df, asking, k, id_col, vec_col)[0]


def search(df: DataFrame, asking: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame | None]:
    """The neighbours, and what each round found for each distinct query: ``_visited`` adds up to the pairs that were scored."""
    given = taking_part(df, asking, id_col, vec_col, False)
    squares = F.aggregate("_vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    d, norm = given.agg(F.max(F.size("_vec")), F.sqrt(F.max(squares))).first()
    classes, members = questions(given)
    m = classes.count()
    if not m:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), None
    dtype = "<f4" if dict(df.dtypes)[vec_col] == "array<float>" else "<f8"
    rows = materialise(candidates(given, k), "candidates")
    across, down = math.ceil(rows.count() / SEGMENT), math.ceil(m / QUERIES)
    segments = packed(rows, d, SEGMENT, dtype, lambda x: x)
    segments = materialise(segments.withColumn("_i", F.pmod(F.xxhash64("_block"), F.lit(across)).cast("int")).drop("_block"), "segments")
    segments = segments.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = classes.select("_class", "_vec", F.pmod(F.xxhash64("_class"), F.lit(down)).cast("int").alias("_j"))

    def visit(state: DataFrame, begin: int, end: int) -> DataFrame:
        spread = state.withColumn("_i", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        some = segments.where((F.col("_i") >= begin) & (F.col("_i") < end))
        found = spread.groupBy("_i", "_j").cogroup(some.groupBy("_i", "_j")).applyInArrow(_search(k + 1, d, norm, dtype), "_class long, _row long, _id long, score double, _visited long")
        return materialise(found, "found")

    # The (k + 1)-th best so far; queries that met fewer look at all cells.
    nothing = F.lit(float("-inf"))
    met, best, end = None, None, 0
    while end < across:
        begin, end = end, min(across, max(1, end * (1 + GROWTH)))
        state = asked.withColumn("_least", nothing)
        if best is not None:
            least = best.groupBy("_class").agg(F.when(F.count("*") > k, F.min("score")).alias("_least"))
            state = asked.join(least, "_class", "left").withColumn("_least", F.coalesce("_least", nothing))
        new = visit(state, begin, end)
        met = new if met is None else met.unionByName(new)
        every = new.where(F.col("_class").isNotNull()).select("_class", "_row", "_id", "score")
        every = every if best is None else every.unionByName(best)
        in_order = Window.partitionBy("_class").orderBy(F.desc("score"), "_id", "_row")
        best = every.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= k + 1).drop("_rank")
        best = materialise(best, "best") if end < across else every
    return ranked(best, classes, members, k, "double"), met


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
