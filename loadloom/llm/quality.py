"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model, against quantiles for each language.

The model is one of bytes, of order ``ORDER``, for each language, trained on all trusted texts but every ``FOLDS``-th,
which set the thresholds.  Counts, continuation counts, discounts, context weights and the interpolated probabilities are
DataFrames; orders meet in equi-joins of count tables dealt by language and n-gram.  A document's score is its mean
surprise a byte, drawn towards the language's mean by ``PRIOR_BYTES`` bytes, so that a few words don't decide; it is kept
if its perplexity is at most the language's quantile.  (A lower limit would reject clean texts and hardly any
others: text that repeats words is no less surprising to a model of bytes.)

Scale: text is never shuffled.  Tasks send counts of distinct n-grams of some MB of text each.  Byte n-grams of a language
saturate, so the finished model is broadcast if it has at most ``MODEL_ROWS`` rows; beyond that, documents' distinct
n-grams with their counts are joined to the sharded tables.  Both ways give the same scores.

Edge cases: null and empty texts have no perplexity and are rejected; a null language is a language of its own; a
language without trusted texts has no threshold, and its documents are kept; repeated rows get equal scores; ids that
occur repeatedly among the labels are trusted if all their labels are; no trusted texts at all: all that has text is kept.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise, table

ORDER, FOLDS, PRIOR_BYTES = 5, 5, 96
UPPER = 0.995
MODEL_ROWS, TRUSTED_IDS = 4_000_000, 1_000_000
CHUNK = 1 << 19
MASK = [(1 << (8 * k)) - 1 for k in range(ORDER + 1)]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, and where each text's begin."""
    pad = ORDER - 1
    b = np.frombuffer(b"".join(b"\0" * pad + t for t in texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    if not len(b):
        return b, np.zeros(0, np.int64)
    g = np.zeros(len(b) - pad, np.int64)
    for k in range(ORDER):
        g = (g << 8) | b[k : len(b) - pad + k]
    # Between two texts lie the n-grams that end in the padding.
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    use = np.ones(len(g), bool)
    use[((starts[1:] + pad * np.arange(len(lengths) - 1))[:, None] + np.arange(pad)).ravel()] = False
    return g[use], starts


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            size += (n or 0) + ORDER
            if size > CHUNK:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 1):
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for lang in sorted({*langs}):
            g, n = np.unique(grams([t for x, t in zip(langs, texts, strict=True) if x == lang and t])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "g", "n"])


def _suffix(k: int) -> Column:
    return F.col("g").bitwiseAND(F.lit(MASK[k]))


def _context() -> Column:
    return F.shiftright("g", 8)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang``, ``k``, ``kind``, ``g``, ``v``: log probabilities ("p") and log context weights ("w") of each order.

    ``counts``: lang, g (n-gram of ORDER bytes), n."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialise(tables[k + 1].groupBy("lang", _suffix(k).alias("g")).agg(F.count("*").alias("n")), "counts")
    # The discounts of all orders at once: few rows, for each language and order.
    n = [F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    # Where a count of counts is nought, the usual values for large samples.
    found = [F.when((n[i] > 0) & (n[0] > 0), F.greatest(F.lit(0.05), F.least(F.lit(i + 0.95), (i + 1) - (i + 2) * y * n[i + 1] / F.nullif(n[i], F.lit(0))))) for i in range(3)]
    every = functools.reduce(DataFrame.unionByName, [t.select("lang", F.lit(k).alias("k"), "n") for k, t in tables.items()])
    discounts = every.groupBy("lang", "k").agg(*[F.coalesce(d, F.lit(0.5 * (i + 1))).alias(f"d{i + 1}") for i, d in enumerate(found)])
    discounts = materialise(discounts, "discounts")
    # A context has at most 256 n-grams, so a window over it is small; its weight is told with the first of them.
    of_context = Window.partitionBy("lang", "c")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        c = tables[k].join(F.broadcast(discounts.where(F.col("k") == k).drop("k")), "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "g", "n", d.alias("d"), _context().alias("c"))
        total = F.sum("n").over(of_context)
        p = c.select("*", total.alias("total"), (F.sum("d").over(of_context) / total).alias("w"), (F.min("g").over(of_context) == F.col("g")).alias("first"))
        if lower is None:
            p = p.withColumn("low", F.lit(1 / 256))
        else:
            p = p.withColumn("s", _suffix(k - 1)).join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("low")), ["lang", "s"])
        lower = materialise(p.select("lang", "g", "c", "w", "first", ((F.col("n") - F.col("d")) / F.col("total") + F.col("w") * F.col("low")).alias("p")), "order")
        out.append(lower.select("lang", F.lit(k).alias("k"), F.lit("p").alias("kind"), "g", F.ln("p").alias("v")))
        out.append(lower.where("first").select("lang", F.lit(k).alias("k"), F.lit("w").alias("kind"), F.col("c").alias("g"), F.ln("w").alias("v")))
    return functools.reduce(DataFrame.unionByName, out)


def surprise(model: dict, g: np.ndarray) -> np.ndarray:
    """-ln p of each n-gram: the longest known one, with the weights of the known contexts above it."""
    total, open_ = np.zeros(len(g)), np.arange(len(g))
    for k in range(ORDER, 0, -1):
        keys, values = model["p", k]
        x = g[open_] & MASK[k]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[at] == x
        total[open_[hit]] += values[at[hit]]
        open_, x = open_[~hit], x[~hit] >> 8
        if not len(open_):
            break
        keys, values = model["w", k]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[at] == x
        total[open_[hit]] += values[at[hit]]
    total[open_] -= math.log(256)
    return -total


def _by_broadcast(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``_nll`` to lang, text and others; text is dropped."""
    found = model.select("lang", (F.col("k") * 2 + (F.col("kind") == "p").cast("int")).cast("byte").alias("of"), "g", F.col("v")).orderBy("lang", "of", "g").toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    ofs, gs, vs = (found.column(c).to_numpy() for c in ("of", "g", "v"))
    starts = np.flatnonzero(np.diff(langs.indices.to_numpy(), prepend=-1) | np.diff(ofs, prepend=ofs[:1] - 1)) if len(ofs) else []
    arrays: dict[str, dict] = {}
    for a, b in zip(starts, [*starts[1:], len(ofs)][: len(starts)], strict=True):
        arrays.setdefault(langs[int(a)].as_py(), {})["p" if ofs[a] % 2 else "w", int(ofs[a]) // 2] = (gs[a:b].copy(), vs[a:b].copy())
    del found, ofs, gs, vs
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    kept = [f for f in docs.schema.fields if f.name != "_text"]
    columns = [docs.columns.index(f.name) for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", _bytes long, _nll double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text, at_lang = docs_columns.index("_text"), docs_columns.index("_lang")
        for batch in _chunks(batches, at_text):
            texts, langs = batch.column(at_text).to_pylist(), batch.column(at_lang).to_pylist()
            nll: list[float | None] = [None] * len(texts)
            for lang in {*langs}:
                rows = [i for i, (x, t) in enumerate(zip(langs, texts, strict=True)) if x == lang and t]
                if not rows or lang not in shared.value:
                    continue
                g, starts = grams([texts[i] for i in rows])
                u, back = np.unique(g, return_inverse=True)
                for i, v in zip(rows, np.add.reduceat(surprise(shared.value[lang], u)[back], starts), strict=True):
                    nll[i] = float(v)
            out = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(nll, pa.float64())], names=[*(f.name for f in kept), "_bytes", "_nll"])

    docs_columns = docs.columns
    return arrow_map(docs, run, schema)


def _by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same with joins to the sharded tables; documents are told apart by id, language and a hash of the text."""
    keyed = docs.withColumn("_row", F.xxhash64("_id", "_lang", "_text")).withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                g, n = np.unique(grams([text])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(g), pa.int64()), pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["_row", "lang", "g", "n"])

    found = arrow_map(keyed.where(F.col("_bytes") > 0).select("_row", "_lang", "_text").dropDuplicates(["_row"]), run, "_row long, lang string, g long, n long")
    found = found.join(model.select("lang").distinct(), "lang", "left_semi")
    value, done = F.lit(0.0), F.lit(False)
    for k in range(ORDER, 0, -1):
        of = lambda kind: model.where((F.col("k") == k) & (F.col("kind") == kind))  # noqa: B023, E731
        found = found.withColumn("_s", _suffix(k)).join(of("p").select("lang", F.col("g").alias("_s"), F.col("v").alias(f"_p{k}")), ["lang", "_s"], "left")
        found = found.withColumn("_c", F.shiftright("_s", 8)).join(of("w").select("lang", F.col("g").alias("_c"), F.col("v").alias(f"_w{k}")), ["lang", "_c"], "left")
        here = F.when(F.col(f"_p{k}").isNotNull(), F.col(f"_p{k}")).otherwise(F.coalesce(f"_w{k}", F.lit(0.0)))
        value = value + F.when(done, 0.0).otherwise(here)
        done = done | F.col(f"_p{k}").isNotNull()
    value = value - F.when(done, 0.0).otherwise(math.log(256))
    sums = found.groupBy("_row").agg((-F.sum(F.col("n") * value)).alias("_nll"))
    return keyed.drop("_text").join(sums, "_row", "left").drop("_row")


def classify(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_rows: int = MODEL_ROWS, extra: Sequence[str] = ()
) -> DataFrame:
    """``id_col``, ``lang``, ``perplexity``, ``score`` (drawn to the mean), ``high`` and ``keep`` for each row of ``df``,
    and its columns ``extra``.

    ``trusted``: the ids, in ``id_col``, of texts to learn from."""
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(lang_col, F.lit("")).alias("_lang"), F.col(text_col).cast("binary").alias("_text"), *extra)
    ids = trusted.select(F.col(id_col).alias("_id")).where(F.col(id_col).isNotNull()).distinct()
    ids = F.broadcast(ids) if ids.limit(TRUSTED_IDS + 1).count() <= TRUSTED_IDS else ids
    held = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)) == 0
    learn = docs.join(ids, "_id", "left_semi").where(~held).select("_lang", "_text")
    counts = arrow_map(learn, _count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    model = kneser_ney(materialise(counts, "grams"))
    score = _by_broadcast if model.limit(model_rows + 1).count() <= model_rows else _by_join
    scored = materialise(score(docs, model), "scores")

    fresh = scored.where(held).join(ids, "_id", "left_semi").where(F.col("_nll").isNotNull())
    means = fresh.groupBy("_lang").agg((F.sum("_nll") / F.sum("_bytes")).alias("_mean"))
    drawn = F.exp((F.col("_nll") + PRIOR_BYTES * F.col("_mean")) / (F.col("_bytes") + PRIOR_BYTES))
    limits = fresh.join(F.broadcast(means), "_lang").withColumn("_score", drawn).groupBy("_lang")
    limits = limits.agg(F.percentile_approx("_score", UPPER, 10_000).alias("high"))
    limits = limits.join(means, "_lang")
    out = scored.join(F.broadcast(limits), "_lang", "left").withColumn("score", drawn)
    keep = (F.col("_bytes") > 0) & F.coalesce(F.col("score") <= F.col("high"), F.lit(True))
    return out.select(F.col("_id").alias(id_col), F.nullif("_lang", F.lit("")).alias("lang"), F.exp(F.col("_nll") / F.col("_bytes")).alias("perplexity"), "score", "high", keep.alias("keep"), *extra)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where(F.col("q") == 1).select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
