"""Classes with boilerplate in their prefix are compared by an order of their own: only those of little else meet in pairs of groups."""

import random

from loadloom.llm import jaccard


def test_groups_hold_only_classes_of_little_but_boilerplate(spark, monkeypatch):
    draw = random.Random(3)
    words = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    line = words(40)
    # Two fifths of boilerplate, which links nothing; then nine tenths, which links all of them; then a link over rarer words.
    mixed, mostly, body = [f"{line} {words(60)}" for _ in range(80)], [f"{line} {words(4)}" for _ in range(4)], words(60)
    pair = [f"{line} {body}", f"{line} {body} {words(5)}"]
    rows, written, write = [*enumerate([*mixed, *mostly, *pair])], {}, jaccard.materialise

    def counted(df, label):
        out = write(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(80)}, **dict.fromkeys(range(80, 84), 80), 84: 84, 85: 84}
    assert 0 < written["anchored"] <= 4
