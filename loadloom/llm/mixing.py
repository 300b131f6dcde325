"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Targets: each source's share of all words by weight, at most ``max_repeats`` times its own words, the
excess reshared by weight.  With caps c and weights w that is min(c, level * w), and ``level`` solves
sum(min(c, level * w)) = total, which running sums over the sources in the order c / w give directly.

Positions: a source's weight at time t in [0, 1] is proportional to 1 + tilt * (1 - 2 t).  Its integral
times the target is the cumulative demand for the source's words; the words that a copy of a document
covers have their midpoint u (as a part of the target) at the time that solves
(1 + tilt) t - tilt t^2 = u.  Copies with u of 1 or more are beyond the demand and aren't taken, so that
a source's taken words differ from its target by half a document at most.

Scale: documents are dealt by (source, leading digits of a digest), so a source with a third of all rows
is spread over 4096 groups; the offsets of the groups are running sums over at most 4096 rows a source.
Only the table of sources, one row each, is ordered in a single task.

Edge cases: a null source is a source of its own, after all others; null and empty texts have size 0; a
source without words has the target 0 and is not taken; an empty table gives an empty result; repeated rows
are rows of their own; equal ids are ordered by size.  Columns of the input that clash with the columns made
here are replaced by them; those that clash with names used on the way are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count

MADE = ("size", "source_size", "target", "copies", "taken", "positions", "first_position")
INNER = ("_key", "_digest", "_group", "_words", "_offset", "_start", "_rank", "_tilt", "_wanted")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sizes`` has ``_key`` (ordered as the sources are) and ``source_size``; adds ``target`` and ``_rank``."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_key")) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(after))
        .withColumn("_level", F.max((F.col("_total") - F.col("_capped")) / F.col("_open")).over(everything))
    )
    # With the sources before one at their caps, the quotient is the level for the rest; it rises while they belong there, then falls.
    return ranked.select("_key", "_rank", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_repeats: int = 3,
    tilts: Sequence[float] = (0.5, 0.0, -0.5),
) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target, copies, taken, the ``positions`` of the copies in
    [0, 1) and the first of them."""
    docs = docs.drop(*[c for c in MADE if c not in (id_col, text_col, source_col)])
    aside = {c: f"input {c}" for c in docs.columns if c.lower() in INNER}
    docs = docs.withColumnsRenamed(aside)
    id_col, text_col, source_col = (aside.get(c, c) for c in (id_col, text_col, source_col))
    base = (
        docs.withColumn("size", word_count(F.col(text_col)))
        .withColumn("_key", F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")))
        .withColumn("_digest", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
        .withColumn("_group", F.substring("_digest", 1, 3))
    )
    groups = base.groupBy("_key", "_group").agg(F.sum("size").alias("_words"))
    targets = source_targets(groups.groupBy("_key").agg(F.sum("_words").alias("source_size")), weights, max_repeats)
    earlier = Window.partitionBy("_key").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_key", "_group", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets, "_key")
    within = Window.partitionBy("_key", "_group").orderBy("_digest", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["_key", "_group"])

    middle = F.col("_offset") + F.col("_start") + F.col("size") / 2
    wanted = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda j: j * F.col("source_size") + middle),
        lambda m: m < F.col("target"),
    )
    tilt = F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), (F.col("_rank") % len(tilts) + 1).cast("int"))

    def time(m):
        u, root = m / F.col("target"), 1 + F.col("_tilt")
        return F.when(F.col("_tilt") == 0, u).otherwise((root - F.sqrt(root * root - 4 * F.col("_tilt") * u)) / F.when(F.col("_tilt") != 0, 2 * F.col("_tilt")))

    return (
        placed.withColumn("_tilt", tilt)
        .withColumn("_wanted", wanted)
        .withColumn("copies", F.size("_wanted").cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn("positions", F.transform("_wanted", time))
        .withColumn("first_position", F.get("positions", F.lit(0)))
        .select(*docs.columns, *MADE)
        .withColumnsRenamed({away: c for c, away in aside.items()})
    )


def in_order(mixed: DataFrame, columns: Sequence[str], position: str, tie: str) -> DataFrame:
    """Range-sorted by position, equal or missing positions by ``tie``, without one task for all."""
    keys = [F.col(position).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns)


def training_order(mixed: DataFrame, columns: Sequence[str], tie: str = "doc_id") -> DataFrame:
    """One row for each copy that the mix takes, in the order of training."""
    return in_order(mixed.withColumn("_position", F.explode("positions")), columns, "_position", tie)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = curriculum(docs)
    return in_order(mixed, ["doc_id", "size", "source_size", "target", "taken", "first_position"], "first_position", "doc_id")


#: The same in DuckDB; ``{d}`` is the relation to mix.
SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('0' || source, '1') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM {d}),
s AS (SELECT k, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY k) - 1 AS r FROM base GROUP BY k),
w AS (SELECT *, [1.0, 2.0, 3.0][(r % 3 + 1)::INT]::DOUBLE AS w, (z * 3)::DOUBLE AS c FROM s),
f AS (SELECT *, (sum(z) OVER ())::DOUBLE AS total,
        coalesce(sum(c) OVER (ORDER BY c / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
        sum(w) OVER (ORDER BY c / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT max((total - capped) / open) AS level FROM f),
t AS (SELECT k, z, r, least(c, level * w) AS target FROM f, l),
p AS (SELECT b.*, t.z, t.target, [0.5, 0.0, -0.5][(t.r % 3 + 1)::INT]::DOUBLE AS tilt,
        coalesce(sum(size) OVER (PARTITION BY b.k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE AS m
      FROM base b JOIN t ON b.k = t.k)
SELECT doc_id, size, z AS source_size, target,
  size * ((m < target)::INT + (z + m < target)::INT + (2 * z + m < target)::INT)::BIGINT AS taken,
  CASE WHEN m < target THEN CASE WHEN tilt = 0 THEN m / target
    ELSE ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * (m / target))) / (2 * tilt) END END AS first_position
FROM p
"""
