"""What the segments of the neighbour search return grows with the logarithm of their number."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from loadloom.llm import ann


def test_rows_returned_by_many_segments(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 40)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out, met = ann.search(df, F.col("vec_id") % 20 == 0, 20)
    m = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = collections.defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        assert r.score == float((m[r.vec_id] * m[r.query_id]).sum())
        found[r.query_id].append(r.vec_id)
    ids, all_ = np.array([*m]), np.array([*m.values()])
    hits = 0
    for q, near in found.items():
        s = all_ @ m[q]
        s[ids == q] = -np.inf
        hits += len({*near} & {*ids[np.argsort(-s)[:20]].tolist()})
    assert hits >= 0.9 * 20 * len(found)
    segments = len(m) / 40
    assert met.where(F.col("score").isNotNull()).count() < 0.3 * 21 * segments * len(found)
    assert met.where(F.col("score").isNotNull()).count() < 21 * len(found) * (1 + ann.GROWTH * math.log(segments, 1 + ann.GROWTH))
