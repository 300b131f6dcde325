"""Language identification by fusing evidence: text, declared language, address suffix and host.

For each page, ln P(language | evidence) is the sum of the text's log likelihood under models of hashed byte trigrams, tempered to
that of at most ``TEMPER`` independent trigrams; of ln P(declared language | language) and ln P(suffix of the address |
language), both estimated from all pages by grouped sums of the text's posteriors; and of the log prior of the host.  Host
priors are smoothed towards those of their domain (the last two labels), and these towards that of all pages; a page's
own vote is taken out of its host's.

Scale: one pass over the pages in Python; what it leaves, a few numbers a page, is written once.  Sums by host, domain, suffix and
declaration are pre-aggregated, so a host with a third of all pages is one row a task; pages meet their hosts in a
sort-merge join, which Spark splits where a host is large.  The text models are fitted on a sample of labelled texts:
``SAMPLE`` a language are expected, chosen by a hash of the id from all of them; their table has a fixed size.

Edge cases: pages without text or address have no evidence of that kind; nothing at all: the prior of all pages; a
declaration that is no known language counts as "other", a missing one as ""; no labelled texts: language null; repeated
rows stay and each votes; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, pieces, table
from .url_filter import host_and_path

SAMPLE, SLOTS, TEMPER, SMOOTH = 1500, 1 << 15, 40.0, 0.5
PULL, EVIDENCE = 4.0, 2.0
BROADCAST_ROWS = 10_000

#: Elements whose text isn't the page's own.
DROPPED = re.compile(r"<!--.*?-->|<(script|style|nav|footer|aside|form|noscript|template)\b.*?</\1\s*>", re.S | re.I)
TAGS = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: str | None) -> str:
    return " ".join(markup.unescape(TAGS.sub(" ", DROPPED.sub(" ", page or ""))).split())


def slots(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text in lower case."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) if len(b) > 2 else np.empty(0, np.int64)


def text_models(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages by name, and ln P(slot | language)."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("lang").isNotNull() & F.col("_text").isNotNull())
    parts = rows.groupBy("lang").agg(F.least(F.lit(1.0), SAMPLE / F.count("*")).alias("_part"))
    chosen = rows.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.col("_part") * 1_000_000).select("lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(slots(text), minlength=SLOTS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "slot", "n"])

    counts = arrow_map(chosen, run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    table_ = np.full((len(langs), SLOTS), SMOOTH)
    for i, lang in enumerate(langs):
        part = counts[counts.lang == lang]
        table_[i, part.slot.to_numpy()] += part.n.to_numpy()
    return langs, np.log(table_ / table_.sum(1, keepdims=True))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``lang``, ``probability``, ``text_lang``, ``declared`` and ``host``."""
    langs, table_ = text_models(labelled)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(id_col, none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), host_and_path(F.col(url_col))[0].alias("host"))
    shared = pages.sparkSession.sparkContext.broadcast((langs, table_.astype(np.float32)))
    host, _ = host_and_path(F.col(url_col))
    cut = pages.select(F.col(id_col), host.alias("host"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for whole in batches:
            for batch in pieces(whole, 2, 256):
                declared, evidence = [], []
                for page in batch.column(2).to_pylist():
                    m = DECLARED.search(page or "")
                    code = m[1].lower() if m else ""
                    declared.append(code if not code or code in names else "other")
                    at = slots(visible(page))
                    log = model[:, at].sum(1, dtype=np.float64) * min(1.0, TEMPER / max(1, len(at))) if len(at) > 2 else np.zeros(len(names))
                    log -= log.max()
                    evidence.append((log - np.log(np.exp(log).sum())).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(evidence, pa.list_(pa.float64()))], names=[id_col, "host", "declared", "_text"])

    kind = dict(pages.dtypes)[id_col]
    seen = materialise(arrow_map(cut, run, f"{id_col} {kind}, host string, declared string, _text array<double>"), "evidence")
    seen = seen.withColumn("_suffix", F.substring_index("host", ".", -1)).withColumn("_domain", F.substring_index("host", ".", -2))
    n = range(len(langs))
    votes = [F.sum(F.exp(F.col("_text")[i])).alias(f"v{i}") for i in n]
    every = lambda d: F.array(*[d(i) for i in n])

    total = seen.agg(*votes).first()
    whole = sum(total) if total[0] is not None else 0
    prior = [((total[i] or 0) + 1) / (whole + len(langs)) for i in n]
    domains = seen.groupBy("_domain").agg(*votes)
    size = sum(F.col(f"v{i}") for i in n)
    domains = domains.select("_domain", every(lambda i: (F.col(f"v{i}") + PULL * prior[i]) / (size + PULL)).alias("_of_domain"))
    hosts = seen.groupBy("host", "_domain").agg(*votes).select("host", "_domain", every(lambda i: F.col(f"v{i}")).alias("_votes"), size.alias("_size"))
    hosts = hosts.join(domains, "_domain").drop("_domain")

    def likelihoods(column: str) -> DataFrame:
        """ln P(value | language)."""
        found = seen.groupBy(column).agg(*votes)
        values = max(1, found.count())
        return found.select(column, every(lambda i: F.ln((F.col(f"v{i}") + EVIDENCE / values) / ((total[i] or 0) + EVIDENCE))).alias(f"_{column}_log"))

    met = seen.join(_checked(likelihoods("declared")), "declared").join(_checked(likelihoods("_suffix")), "_suffix").join(hosts, "host")
    own = lambda i: F.exp(F.col("_text")[i])
    host_log = lambda i: F.ln((F.greatest(F.lit(0.0), F.col("_votes")[i] - own(i)) + PULL * F.col("_of_domain")[i]) / (F.col("_size") - 1 + PULL))
    log = every(lambda i: F.col("_text")[i] + F.col("_declared_log")[i] + F.col("__suffix_log")[i] + host_log(i))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    met = met.withColumn("_log", log).withColumn("_top", F.array_max("_log"))
    weight = F.aggregate(F.transform("_log", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda t, x: t + x)
    return met.select(id_col, best(F.col("_log")).alias("lang"), (1 / weight).alias("probability"), best(F.col("_text")).alias("text_lang"), "declared", "host")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
