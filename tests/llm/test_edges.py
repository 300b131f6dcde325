"""Every corpus operator on empty tables, rows that are null throughout, and columns that clash with those it makes."""

import pytest
from pyspark.sql import functions as F

from loadloom.llm import ann, bpe, jaccard, language, mixing, pii, quality, quotes, topk, url_filter

TEXTS = [None, "", "a b", "the same words again and again in one text", "the same words again and again in one text", "mail x@y.org or +1 (375) 555-4393"]
CLASHES = (
    "_id", "_hash", "_key", "_n", "_k", "_g", "_v", "_w", "_rank", "_text", "_lang", "_at", "_p", "_x", "_set", "_size", "id", "key", "hash", "n", "k", "g", "v", "value", "score", "rank", "count", "keep", "size", "position", "taken",
    "target", "ids", "n_tokens", "entities", "host", "path", "rule", "verdict", "component_id", "n_shingles", "query_id", "perplexity", "copies", "thread", "depth", "reply_to", "probability", "u", "w", "block", "col", "pos",
)


def docs(spark):
    return spark.createDataFrame([(i if i else None, t, "en" if i > 1 else None, "s" if i > 2 else None, None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


def vecs(spark):
    rows = [(None, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (6, [2.0, 1.0]), (8, [0.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def pages(spark):
    return spark.createDataFrame([(None, None, None), (1, "http://a.net/es/x", "<html lang='es'>hola a todos</html>"), (1, "http://a.net/es/x", None)], "page_id long, url string, html string")


def turns(spark):
    return spark.createDataFrame([(None, None, None, None), (1, 0, "user", "Hello there"), (1, 1, "user", "> Hello there\nYes")], "conv_id long, turn long, role string, text string")


OPERATORS = {
    "quality": (docs, lambda s, d: quality.classify(d, s.createDataFrame([(3,)], "doc_id long"))),
    "jaccard": (docs, lambda s, d: jaccard.linked_components(d)),
    "language": (pages, lambda s, d: language.identify(d, docs(s))),
    "bpe": (docs, lambda s, d: bpe.digests(bpe.encode_documents(d, bpe.default_vocabulary()))),
    "mixing": (docs, lambda s, d: mixing.curriculum(d)),
    "topk": (vecs, lambda s, d: topk.exact_top_k(d, F.col("vec_id") % 2 == 0, 2)),
    "pii": (docs, lambda s, d: pii.pseudonymise(d)),
    "quotes": (turns, lambda s, d: quotes.reply_order(d)),
    "url": (pages, lambda s, d: url_filter.filter_urls(d, url_filter.rule_table(s))),
    "ann": (vecs, lambda s, d: ann.nearest(d, F.col("vec_id") % 2 == 0, 2)),
}


def plain(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    make, run = OPERATORS[name]
    assert run(spark, make(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_rows(spark, name):
    make, run = OPERATORS[name]
    rows = make(spark)
    nothing = rows.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    got = run(spark, nothing).count()
    assert got == (0 if name in ("topk", "ann") else 2)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    make, run = OPERATORS[name]
    rows = make(spark)
    want = run(spark, rows)
    clash = run(spark, rows.withColumns({c: F.lit("clash") for c in CLASHES if c not in rows.columns}))
    assert plain(clash, want.columns) == plain(want, want.columns)


def test_language_without_labelled_text(spark):
    assert language.identify(pages(spark), docs(spark).limit(0)).count() == 3
