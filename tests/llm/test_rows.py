"""Rows that repeat ids, names, equal turns and surrogates of a whole table, against brute force."""

import collections
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.llm import ann, common, pii, quotes, topk, url_filter

DATA = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def first(rows, asker, k, score):
    """The first k of all rows but one, ties to the smaller id, null ids last."""
    rest = [(-score(rows[asker][1], v), i is None, i or 0) for n, (i, v) in enumerate(rows) if n != asker]
    return [(None if none else i, -s) for s, none, i in sorted(rest)[:k]]


def by_query(out):
    lists = collections.defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        lists[r.query_id, r.rank].append((r.vec_id, r.score))
    return {k: sorted(v, key=repr) for k, v in lists.items()}


@pytest.mark.parametrize("operator", ["top", "near"])
def test_each_row_is_a_query_and_a_candidate(spark, operator):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-4, 5, 6) / 4) for i in rng.integers(1, 60, 150)]
    rows += [(50, rows[0][1]), (50, rows[1][1]), (60, rows[0][1]), (60, rows[0][1]), (None, rows[0][1]), (None, rows[2][1])]
    rows += [(50, np.ones(6) / 4)] * 12  # more equal rows than are asked for
    rows = [(i, v) for i, v in rows if np.any(v)]
    df = vectors(spark, rows)
    asking = F.col("vec_id") % 10 == 0
    floor = lambda a, b: int(np.floor(a * 256) @ np.floor(b * 256))
    if operator == "top":
        got, k, score = by_query(topk.exact_top_k(df, asking, 5)), 5, floor
    else:
        # All rows are few enough to be visited.
        got, k, score = by_query(ann.nearest(df, asking, 5)), 5, lambda a, b: float((a.astype(np.float32).astype(float) * b).sum())
    want = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None and i % 10 == 0:
            for rank, x in enumerate(first(rows, n, k, score), 1):
                want[i, rank].append(x)
    scores = lambda lists: {key: sorted(s for _, s in v) for key, v in lists.items()}
    if operator == "top":
        assert got == {key: sorted(v, key=repr) for key, v in want.items()}
    else:
        assert got.keys() == want.keys()
        a, b = scores(got), scores(want)
        assert sum(x == y for key in a for x, y in zip(a[key], b[key], strict=True)) >= 0.9 * sum(map(len, b.values()))


def test_recall_and_share_of_scored_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out, met = ann.search(df, F.col("vec_id") % 20 == 0, 20)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    m, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found = collections.defaultdict(set)
    for r in out.collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for n in np.flatnonzero(ids % 100 == 0):
        s = m @ m[n]
        s[n] = -np.inf
        hits, total = hits + len(found[int(ids[n])] & {*ids[np.argsort(-s)[:20]].tolist()}), total + 20
    assert hits / total >= 0.9
    pairs = met.agg(F.sum("_visited")).first()[0] / (len(ids) * int((ids % 20 == 0).sum()))
    assert pairs < 0.65  # of vectors without structure; the README has the shares of larger tables
    clustered = vectors(spark, [(i, v) for i, v in enumerate(np.repeat(np.eye(64)[:40], 100, 0) + 0.05 * np.random.default_rng(2).standard_normal((4000, 64)))])
    _, met = ann.search(clustered, F.col("vec_id") % 20 == 0, 20)
    assert met.agg(F.sum("_visited")).first()[0] < 0.1 * 4000 * 200


def plain_replies(rows):
    """reply_to, depth and thread of each row, by trying all messages."""
    parts = [quotes.parse(t) for _, _, _, t in rows]
    own = [quotes.passages(quotes.own_text(p)) for p in parts]
    order = lambda n: (rows[n][1], rows[n][2] or "", n)
    up = {}
    for n, (conv, turn, _, _) in enumerate(rows):
        best = None
        for level, _, bare in parts[n]:
            for h in quotes.hashes(bare) if level else ():
                having = [m for m in range(len(rows)) if rows[m][0] == conv and rows[m][1] is not None and h in own[m]]
                if having:
                    m = min(having, key=order)
                    if turn is not None and rows[m][1] < turn:
                        key = (level, -rows[m][1])
                        best = min(best, (key, m)) if best else (key, m)
        if best:
            up[n] = best[1]
    out = []
    for n in range(len(rows)):
        depth, at = 0, n
        while at in up:
            depth, at = depth + 1, up[at]
        out.append((rows[n][0], rows[n][1], rows[n][2], rows[up[n]][1] if n in up else None, depth, rows[at][1]))
    return sorted(out, key=repr)


def test_replies_against_all_messages(spark):
    rng = random.Random(3)
    rows, said = [], []
    for conv in (1, 2, None):
        said = []
        for turn in range(40):
            for _ in range(rng.choice((1, 1, 2))):  # equal turns
                role = rng.choice(("user", "assistant", "tool"))
                text = f"{rng.choice('abcdefgh')} says {rng.randrange(60)} things\nand {rng.choice('abcdefgh')} {rng.randrange(40)} more"
                if said and rng.random() < 0.7:
                    quoted = rng.choice(said)
                    lines = [x for x in quoted.split("\n")]
                    text = "\n".join("> " + x for x in (lines if rng.random() < 0.5 else lines[-1:])) + "\n" + text
                if rng.random() < 0.1:
                    text = "> 5 items\n" + text
                said.append(text)
                rows.append((conv, turn, role, text))
    rows += [(2, 0, "user", rows[0][3]), (2, None, "user", "no turn"), (2, 41, None, None), (2, 41, None, ""), (3, 0, "user", "Hello there my friend"), (3, 1, "assistant", "> Hello there my friend"), (3, 1, "tool", "no quote at all")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.reply_order(df).collect()
    assert sorted([(r.conv_id, r.turn, r.role, r.reply_to, r.depth, r.thread) for r in out], key=repr) == plain_replies(rows)
    assert sum(r.reply_to is not None for r in out) > 60 and max(r.depth for r in out) >= 3
    assert any("> 5 items" in r.text for r in out) and all(r.n_linked <= r.n_quotes for r in out)
    assert [(r.reply_to, r.role) for r in out if r.conv_id == 3 and r.turn == 1] in ([(0, "assistant"), (None, "tool")], [(None, "tool"), (0, "assistant")])


TEXTS = [
    "Form: password: ______ here", "Password=........", "token: ~~~~~~~~", "Herr Ææ kam", "Dr Øø and Mr Ðð", "Herr Fritz Fischer and Frau Ingrid Öz", "Dr Andrea Weber rang; Herr Andrea Weber came",
    "Mr O'NEIL and Mrs Anna-Lena Lüdenscheidt", "Mr James Smith, Mr John Smith, Mr Robert Smith", "password: aaaaaa password: bbbbbb", "password=1 secret=22 token=333333", "Госпожа Анна Иванова и Господин Иван Иванов",
    "ssn 123-45-6789 and 987-65-4321", "from 10.0.0.1 to 192.168.1.9 by 8.8.8.8 or 172.16.9.1", "+1 (375) 555-4393, +1-375-555-4393", None, "", "nothing here",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_surrogates_of_hard_texts(spark):
    both = []
    for most in (pii.BROADCAST_BYTES, -1):  # the broadcast, and the join beyond it
        both.append({r.doc_id: r.text for r in pii.pseudonymise(frame(spark, TEXTS), broadcast_bytes=most).collect()})
    assert both[0] == both[1]
    got = [both[0][i] for i in range(len(TEXTS))]
    assert got[:3] == TEXTS[:3] and got[-3:] == TEXTS[-3:]
    assert re.fullmatch(r"Herr [A-Z][a-z]+ kam", got[3]) and got[3] != TEXTS[3] and "Øø" not in got[4] and "Fritz" not in got[5]
    andrea = [got[6].split()[1], got[6].split()[5]]
    assert andrea[0] == andrea[1] and pii.gender_of("Andrea")[0] == "f"  # the title makes both a man's
    assert got[11].split()[2].endswith("ова") and got[11].split()[6].endswith("ов")
    phones = got[14].split(", ")
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and phones[0].startswith("+1 (")
    assert got[13].split()[1].startswith("10.") and got[13].split()[3].startswith("192.168.") and got[13].split()[7].startswith("172.")


def test_surrogates_are_distinct_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    given = [f"Mr {a} {b}" for a, b in itertools.product(pii.GIVEN["m", "latin"][:8] + ["Fritz", "Xerxes", "Ben"], ["Smith", "Jones", "Fischer", "Stein"])]
    small = [f"password: {a}{b}-----" for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", "0123456789")]  # every value of a format
    texts = [r.text for r in docs] + given + small
    before = collections.defaultdict(set)
    for t in texts:
        for k, a, b, _ in pii.find(t):
            before[k].add(pii.canonical(k, t[a:b]))
    entities = [(k, v, 0, 0) for k, values in before.items() for v in values]
    out = pii.assigned(spark.createDataFrame(entities, "type string, value string, m long, f long")).collect()
    assert len(out) == len(entities) and sum(map(len, before.values())) > 340
    after = collections.defaultdict(list)
    for r in out:
        assert r.surrogate != r.value
        after[r.type].append(r.surrogate)
    for kind, values in after.items():
        assert len(values) == len({*values}), kind
        real = before[kind] & {*values}
        assert not real or kind == "secret" and all(re.fullmatch("[a-z][0-9]-----", x) for x in real), kind


def test_very_long_texts(spark):
    lines = [f"line {i} of a long message" for i in range(40_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "assistant", "\n".join("> " + x for x in lines) + "\nyes"), (1, 2, "user", ">" * 500 + " deep\n" + "> line 39999 of a long message\nno")]
    got = {r.turn: r for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].reply_to == 0 and got[1].text == "yes" and got[2].reply_to == 0 and got[2].depth == 1 and got[2].text.startswith(">>>>") and got[2].text.endswith("no")
    urls = ["http://" + "a." * 50_000 + "example.com/en/" + "x" * 1_000_000, "http://example.com/" + "en/" * 100_000, "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    assert [got[i].rule for i in range(3)] == ["example.com/en/", "example.com/en/", None] and got[0].host.startswith("a.a.") and len(got[1].path) == 300_001


def test_tables_of_a_stage_are_deleted(spark, tmp_path):
    kept = []

    def stage():
        kept.append(common.materialise(spark.range(5).toDF("a"), "inner"))
        return kept[0].withColumn("b", F.lit(1))

    out = common.finished(stage, "outer")
    place = lambda df: df.stored_at.removeprefix("file://")
    assert out.count() == 5 and os.path.isdir(place(out)) and not os.path.isdir(place(kept[0]))
    common.discard(out)
    assert not os.path.isdir(place(out))
    with pytest.raises(Exception):
        common.finished(lambda: spark.range(3).selectExpr("raise_error('x') AS a"), "bad")
    assert common._open == []
