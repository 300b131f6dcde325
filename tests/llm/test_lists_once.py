"""Components by the driver and by DataFrames agree; the Jaccard join's rounds of tokens read each class's list only."""

import random

from loadloom.llm import common, components, jaccard


def test_both_ways_of_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(20)] + [(7, 7), (2**62, -(2**62))]
    df = spark.createDataFrame(edges, "u long, v long")
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {u: r for u, r in root.items() if u != r}
    steps = []
    monkeypatch.setattr(components, "_large_star", lambda e, f=components._large_star: steps.append(1) or f(e))
    assert {tuple(r) for r in components.components(df).collect()} == {*want.items()} and not steps
    assert not components.components(df.limit(0)).collect()
    monkeypatch.setattr(components, "GATHERED_BYTES", 16)
    assert {tuple(r) for r in components.components(df).collect()} == {*want.items()} and steps


def test_rounds_of_tokens_read_lists(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(n, " ".join(f"w{n % 7}x{i}" for i in range(30 + n % 3))) for n in range(60)], "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    seen = []

    def written(df, label):
        if label == "tokens":
            seen.append({p.name.split("-")[0] for p in tmp_path.iterdir()})
        return common.materialise(df, label)

    monkeypatch.setattr(jaccard, "materialise", written)
    assert len({r.component_id for r in jaccard.linked_components(docs).collect()}) == 7
    assert len(seen) == jaccard.TOKEN_ROUNDS and all("lists" in x and "sketches" not in x for x in seen)
    assert not {"lists", "inside"} & {p.name.split("-")[0] for p in tmp_path.iterdir()}
