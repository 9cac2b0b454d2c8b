"""The grouped prefix join against all pairs."""

from __future__ import annotations

import random
import re

import hostile
import pytest
from test_llm_near_dup import corpus, family, roots
from tidemark.llm import jaccard


def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(links, texts)


def check(spark, texts):
    got = {r.doc_id: r for r in jaccard.linked(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    sizes, want = brute(texts)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    return want


def edges_of_similarity():
    """Pairs exactly at, just above and just below 0.8, short texts, one passage in many documents."""
    draw, texts = random.Random(4), {}
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage = fresh(30)
    for same, own_a, own_b in ((80, 10, 10), (80, 20, 0), (79, 11, 10), (81, 9, 10), (8, 1, 1), (8, 2, 0), (4, 1, 0), (1, 0, 0)):
        shared = fresh(same + 4)
        texts[len(texts)] = " ".join(shared + fresh(own_a))
        texts[len(texts)] = " ".join(shared + fresh(own_b)).upper()
    for _ in range(60):
        texts[len(texts)] = " ".join(fresh(draw.randrange(12)) + passage + fresh(draw.randrange(12)))
    for n in range(8):
        texts[len(texts)] = " ".join(["same"] * n)
        texts[len(texts)] = "a b c d e"[: 2 * n]
    return texts


@pytest.mark.parametrize("small", [32, 1])
def test_components_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    want = check(spark, corpus())
    assert len(set(want.values())) < len(want)
    check(spark, edges_of_similarity())


@pytest.mark.parametrize("block", [512, 40])
def test_pairs_within_a_large_family(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", 0)
    want = check(spark, family(90))
    assert 40 < len(set(want.values())) < len(want)


def test_hostile_rows(spark, hostile_docs, no_docs):
    got = jaccard.linked(hostile_docs).collect()
    assert len(got) == len(hostile.rows()) and jaccard.linked(no_docs).count() == 0
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[7] == by_id[5] == by_id[6] == 5 and by_id[8] == by_id[9] == 8
    assert all(by_id[i] == i for i in (0, 1, 2, 3, 4, 10, 11))
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["5", "None"]
