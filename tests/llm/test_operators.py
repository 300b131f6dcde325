"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.llm import ann, bpe, components, jaccard, language, mixing, pii, quality, queries, quotes, topk, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, entities string, size string, host string"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s" if i % 3 else None, len(t or ""), "x", "y", "z", "h") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n", "a", "a b c d", "word " * 30_000, "The same text of some more words than five.", "The same text of some more words than five.", "<|endoftext|>mail a.b@c.org now"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    rows = lambda data: sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in data), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def brute_components(texts, t=75):
    sets = [set(jaccard.shingles((x or "").encode(), 5).tolist()) for x in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= t * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_components(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(8)]
    line = " ".join(rng.choice(words, 25))
    texts = list(ODD)
    for b in base[:4]:  # chains of copies about as similar as the threshold, some with boilerplate
        for _ in range(60):
            x = b.split()
            for k in rng.integers(0, len(x), rng.integers(0, 4)):
                x[k] = "z" + str(rng.integers(1_000_000))
            texts.append(" ".join(x) + (" " + line if rng.random() < 0.5 else ""))
    texts += [f"{line} {b}" for b in base] * 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(documents(spark, texts)).collect()}
    assert got == brute_components(texts)
    assert jaccard.linked_components(documents(spark, []).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "u long, v long")
    got = {r.u: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)}


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    t = Tokenizer.from_file(path)
    texts = [*ODD, "İstanbul ΣΑΣ it's 12 🙂 中文 \x1c\x85‍", "ababab" * 5000, "x<|startoftext|>y<|endoftext|>"]
    rows = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(documents(spark, texts), path)).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = bpe.decode_documents(bpe.encode_documents(documents(spark, texts), path, decoded=False), path)
    assert {r.doc_id: r.decoded for r in again.collect()}[3] == t.decode(t.encode("a", add_special_tokens=False).ids)
    assert bpe.encode_documents(documents(spark, []).limit(0), path).count() == 0


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("w" * int(rng.integers(0, 30))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 3000, p=[0.7, 0.1, 0.1, 0.05, 0.05]))]
    docs = spark.createDataFrame([(i, t, None if s is None else str(s), "x") for i, t, s in rows], "doc_id long, text string, source string, taken string")
    out = mixing.curriculum(docs).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # as the contract says: the excess is shared again until none is above
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    target |= share
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    assert mixing.curriculum(docs.limit(0)).count() == 0
    assert len(mixing.curriculum(documents(spark, ODD)).collect()) == len(ODD)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_exact_top_k_with_ties(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (200, 8)) / 4
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(m)] + [(900, None, "x"), (901, [float("nan")] * 8, "x"), (902, [None] * 8, "x")]
    df = vectors(spark, rows)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(m * 256).astype(int)
    for i in range(0, 200, 50):
        s = q @ q[i]
        assert got[i] == [(j, s[j]) for j in sorted((j for j in range(200) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert topk.exact_top_k(df.limit(0), F.lit(True), 5).count() == 0
    few = df.where("vec_id < 3")
    assert topk.exact_top_k(few, F.col("vec_id") == 0, 5).count() == 2


def test_neighbours_recall_and_short_lists(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((1500, 16)) + 2 * rng.standard_normal((10, 16))[rng.integers(0, 10, 1500)]
    m[7] = m[20]
    m[8] = 0
    df = vectors(spark, [(i, [float(x) for x in r], "x") for i, r in enumerate(m)])
    m = m.astype(np.float32).astype(float)
    hits = total = 0
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        assert abs(r.score - m[r.vec_id] @ m[r.query_id]) < 1e-9 and r.vec_id not in (8, r.query_id)
        found[r.query_id].append(r.vec_id)
    for i in range(0, 1500, 20):
        s = m @ m[i]
        s[[i, 8]] = -np.inf
        hits, total = hits + len({*found[i]} & {*np.argsort(-s)[:10]}), total + 10
    assert hits / total >= 0.9
    few = df.where("vec_id < 6")
    assert ann.nearest(few, F.col("vec_id") == 0, 10).count() == 5


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "ftp://net/fr/", "x.net/es/", "http://m.net/es", "http://com", None, "", "http://m.net/es/1", "http://m.net/es/1"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, url_filter.rule_table(spark)).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2] == ("net", "/fr/", "net/fr/", "block") and got[3] == ("", "", None, "allow") == got[6] == got[7]
    assert got[4][2] is None and got[5] == ("com", "", None, "allow") and got[8] == got[9] == ("m.net", "/es/1", "net/es/", "block")
    url_filter.BROADCAST_RULES, kept = 0, url_filter.BROADCAST_RULES
    try:
        again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, url_filter.rule_table(spark)).collect()}
    finally:
        url_filter.BROADCAST_RULES = kept
    assert again == got
    none = url_filter.filter_urls(rows, url_filter.rule_table(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_surrogates(spark):
    values = [tuple(pii.permute(pii.KEY, "x", [a, b, c], [3, 4, 5])) for a in range(3) for b in range(4) for c in range(5)]
    assert len({*values}) == 60
    cards = ["4863730426282943", "4207051279108084"]
    texts = [*ODD, f"Pay {cards[0]} or {cards[0][:4]} {cards[0][4:8]} {cards[0][8:12]} {cards[0][12:]}, IBAN DE89 3704 0044 0532 0130 00.", "Write A.B@c.org, call +1 (375) 555-4393 from 49.37.233.206; password=b7db7aa4a5fcc78305", "Frau Anna Schmidt met Herr Hans Schmidt"]
    rows = {r.doc_id: r for r in pii.pseudonymise(documents(spark, texts)).collect()}
    assert rows[0].text is None and rows[1].text == "" and rows[6].text == texts[6] and rows[5].text == texts[5]
    new = rows[9].text
    assert cards[0] not in new and new.split()[1] == "".join(new.split(" or ")[1].split(",")[0].split())
    assert pii.luhn(new.split()[1]) % 10 == 0 and pii.iban_rest(new.split("IBAN ")[1].rstrip(".").replace(" ", "")) == 1
    mail = [rows[8].text.split()[1].lower(), rows[10].text.split()[1].rstrip(",").lower()]
    assert mail[0] == mail[1] != "a.b@c.org" and "b7db7aa4a5fcc78305" not in rows[10].text and "+1 (" in rows[10].text
    people = rows[11].text.split()
    assert people[1] in pii.GIVEN["f", "latin"] and people[5] in pii.GIVEN["m", "latin"] and people[2] == people[6] != "Schmidt"
    assert all(r.text[e["start"] : e["end"]] for r in rows.values() if r.text for e in r.entities)
    assert pii.pseudonymise(documents(spark, []).limit(0)).count() == 0


def test_reply_order(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> how are  you\nFine, thanks"), (1, 2, "user", "other"), (1, 3, "user", ">> How are you?\n> Fine, thanks\nGood"), (1, 3, "user", ">> How are you?\n> Fine, thanks\nGood"), (1, 4, "user", "> unknown\nx"), (2, 0, None, None), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.thread, r.depth, r.turn, r.reply_to, r.text) for r in quotes.reply_order(df).collect() if r.conv_id == 1]
    assert got == [(1, 0, 0, 0, None, rows[0][3]), (1, 0, 1, 1, 0, "Fine, thanks"), (1, 0, 2, 3, 1, "Good"), (1, 0, 2, 3, 1, "Good"), (1, 2, 0, 2, None, "other"), (1, 4, 0, 4, None, "> unknown\nx")]
    assert quotes.reply_order(df).count() == len(rows) and quotes.reply_order(df.limit(0)).count() == 0


def test_quality_ways_agree_and_junk_goes(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    ids = quality.trusted_ids(labels)
    some = docs.limit(60).unionByName(documents(spark, ODD).select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    a = {r.doc_id: r for r in quality.classify(some, ids).collect()}
    b = {r.doc_id: r for r in quality.classify(some, ids, model_rows=1).collect()}
    assert a.keys() == b.keys() and all(x.keep == b[i].keep and (x.score is None or abs(x.score - b[i].score) < 1e-9) for i, x in a.items())
    assert not a[10_000].keep and not a[10_001].keep and a[10_000].perplexity is None
    judged = {r.doc_id: r.keep for r in quality.classify(docs, ids).collect()}
    good = [judged[r.doc_id] for r in labels.where("quality = 1").collect()]
    bad = [judged[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.6
    assert quality.classify(some, ids.limit(0)).where("keep").count() > 60


def test_probabilities_add_up(spark):
    grams, n = np.unique(quality.grams([b"abracadabra", b"abba"])[0], return_counts=True)
    counts = spark.createDataFrame([("x", int(g), int(k)) for g, k in zip(grams, n, strict=True)], "lang string, g long, n long")
    model = {}
    for r in quality.kneser_ney(counts).collect():
        model.setdefault((r.kind, r.k), []).append((r.g, r.v))
    model = {k: tuple(np.array(c) for c in zip(*sorted(v), strict=True)) for k, v in model.items()}
    for context in (b"abra", b"zzzz", b"\0\0\0\0"):
        g = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert abs(np.exp(-quality.surprise(model, g)).sum() - 1) < 1e-9


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = spark.createDataFrame([(9000, None, None), (9001, "http://x.example.net/fr/1", ""), (9001, "http://x.example.net/fr/1", "")], "page_id long, url string, html string")
    got = language.identify(pages.unionByName(odd), docs).collect()
    assert len(got) == pages.count() + 3 and all(r.lang and 0 < r.probability <= 1 for r in got)
    path = {r.page_id: r.lang for r in pages.select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang")).collect()}
    assert sum(path.get(r.page_id, r.lang) == r.lang for r in got) / len(got) > 0.9


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
    assert "doc_id" in p.run(spark, DATA).columns


def test_one_of_each_tells_rows_of_an_id_apart(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    text = [" ".join(rng.choice([f"w{i}" for i in range(3000)], 60)) for _ in range(9)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[0] + " x"), (2, text[2]), (3, text[3]), (None, text[3] + " y")]
    rows += [(None, text[4]), (None, text[5]), (None, text[6]), (None, text[6]), (None, text[6] + " z"), (None, None), (None, None), (None, "a"), (None, "a"), (4, "a"), (4, "a"), (5, "a"), (4, None), (6, ""), (6, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.one_of_each(spark, df, DATA).collect()]
    third = {t for i, t in got if i is None and t and t.startswith(text[6])}
    want = [(1, text[0]), (1, text[1]), (2, text[2]), (3, text[3]), (None, text[4]), (None, text[5]), (None, *third), (None, None), (None, None), (4, "a"), (4, None), (6, ""), (7, "")]
    assert len(third) == 1 and sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_keeps_little_junk(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id: r.keep for r in quality.classify(spark.read.parquet(f"{data}/documents.parquet"), quality.trusted_ids(labels)).collect()}
    bad = [kept[r.doc_id] for r in labels.where("quality = 0").collect()]
    good = [kept[r.doc_id] for r in labels.where("quality = 1").collect()]
    assert sum(bad) / len(bad) < 0.04 and sum(good) / len(good) > 0.99
