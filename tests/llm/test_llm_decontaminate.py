"""Containment search against all pairs of documents and items."""

from __future__ import annotations

import random

from test_llm_text import plain_words
from tidemark.llm import decontaminate


def runs(text):
    w = plain_words(text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_equals_all_pairs(spark, monkeypatch):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = {i: text(n) for i, n in enumerate((5, 6, 9, 14, 30, 60, 200, 700, 3, 1))}
    docs = {}
    for n in (3, 20, 400, 30_000):
        for item in items.values():
            words = text(n).split()
            words[len(words) // 2 : len(words) // 2] = item.upper().replace(" ", ", ").split()
            docs[len(docs)] = " ".join(words)
        broken = items[5].split()
        for at in (10, 40):  # two words changed: some runs are lost
            broken[at] = "other"
        docs[len(docs)] = text(n) + " " + " ".join(broken)
        docs[len(docs)] = text(n)
    sets = {i: runs(t) for i, t in items.items()}
    want = {(d, i) for d, t in docs.items() for i, s in sets.items() if len(runs(t) & s) >= 0.8 * len(s)}
    assert len(want) > 30
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = decontaminate.contaminations(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == set(docs) - {d for d, _ in want}
    monkeypatch.setattr(decontaminate, "ITEM_SHINGLES", 100)  # several passes
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(df, bench).collect()} == want


def test_hostile_rows(spark, hostile_docs, no_docs):
    import hostile

    bench = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " .. ", None), (4, hostile.PROSE, None), (5, hostile.PROSE, None), (None, "one", None)],
                                  "item_id bigint, text string, doc_id string")
    got = decontaminate.contaminations(hostile_docs, bench).collect()
    assert sum(r.item_id == 4 for r in got) == sum(r.item_id == 5 for r in got) == 6
    assert [r.doc_id for r in got if r.item_id is None] == [4]
    left = decontaminate.clean(hostile_docs, bench)
    assert left.columns == hostile_docs.columns and left.count() == len(hostile.rows()) - 7
    assert decontaminate.contaminations(no_docs, bench).count() == 0
    none = bench.limit(0)
    assert decontaminate.contaminations(hostile_docs, none).count() == 0
    assert decontaminate.clean(hostile_docs, none).count() == len(hostile.rows())
