"""What the Jaccard join leaves on the disk, and pairs of groups dealt into rounds."""

import random
import re

from loadloom.llm import common, jaccard


def test_rounds_give_equal_rows_and_leave_little(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [line + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(5 + n % 9)) for n in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(jaccard, "GROUP_CLASSES", 4)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(root)
    left = {re.sub(r"-[0-9a-f]{32}$", "", p.name) for p in tmp_path.iterdir()}
    assert not left & {"pairs", "ids", "packs", "sketches", "tokens", "prefix", "rooted", "cells", "anchored", "met", "usual"}
