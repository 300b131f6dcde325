"""Tokens are counted in rounds, and the driver gives memory back while tables are written."""

import random

from loadloom.llm import common, jaccard


def test_tokens_are_dealt_into_rounds(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(40)]
    texts += [t + " end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    want = {r.doc_id: r.component_id for r in jaccard.linked_components(docs).collect()}
    sizes, write = [], jaccard.materialise

    def recorded(df, label):
        out = write(df, label)
        if label == "tokens":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", recorded)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(docs).collect()}
    assert got == want and all(got[40 + i] == i for i in range(20))
    assert len(sizes) == jaccard.TOKEN_ROUNDS and max(sizes) < 0.5 * sum(sizes)


def test_the_driver_gives_memory_back(spark, monkeypatch):
    said, trim = [], common._trim
    monkeypatch.setattr(common, "_trim", lambda *a: said.append(trim(*a)))
    monkeypatch.setattr(common, "LET_GO_S", -1.0)
    common.materialise(spark.range(3), "few")
    assert len(said) == 1 and "rim" in said[0]
