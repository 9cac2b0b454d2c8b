"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import hostile
from test_llm_text import plain_words
from tidemark.llm import near_dup
from tidemark.llm.components import components


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def bag(text):
    w = plain_words(text or "")
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(texts):
    bags = {i: bag(t) for i, t in texts.items()}
    links = [(a, b) for a in bags for b in bags if a < b and bags[a] and
             sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    return links, roots(links, texts)


def corpus():
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "su") for b in ("t", "n", "r", "st", "l", "x")]
    texts = {}
    for group in range(12):
        base = draw.choices(vocabulary, k=draw.choice((6, 40, 150, 400)))
        for copy in range(draw.choice((1, 3, 12))):
            words = list(base)
            for _ in range(int(len(words) * draw.uniform(0, 0.025))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts[len(texts) * 3] = " ".join(words).capitalize() + draw.choice((".", "!", ""))
    for _ in range(4):
        texts[len(texts) * 3] = texts[draw.choice(list(texts))]
    return texts


def test_classes_equal_all_pairs(spark):
    texts = corpus()
    links, want = brute(texts)
    assert 10 < len(links)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())
    kept = near_dup.deduplicated(df.withColumnRenamed("doc_id", "doc_id"))
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def family(twins):
    """Texts at 0.74 or so to one another, in pairs at 0.82."""
    draw = random.Random(5)
    base = [f"base{i}" for i in range(400)]
    texts = {}
    for _ in range(twins):
        both = [(p, f"new{draw.random()}") for p in draw.sample(range(80), 2)]
        for _ in range(2):
            own = [(p, f"new{draw.random()}") for p in draw.sample(sorted(set(range(80)) - {p for p, _ in both}), 4)]
            words = list(base)
            for place, word in both + own:
                words[place * 5 + 2] = word.replace(".", "x")
            texts[len(texts)] = " ".join(words)
    return texts


def test_pairs_within_a_large_family_are_found(spark, monkeypatch):
    texts = family(200)
    shingled = {i: set(bag(t)) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in range(a + 1, len(texts)) if len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])]
    want = roots(links, texts)
    assert 100 < len(set(want.values()))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for block in (512, 30):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == want


def test_hostile_rows(spark, hostile_docs, no_docs):
    got = near_dup.near_duplicates(hostile_docs).collect()
    assert len(got) == len(hostile.rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].class_id == by_id[5].class_id == by_id[6].class_id
    assert by_id[8].class_id == by_id[9].class_id == 8
    assert all(r.kept and r.class_id == r.doc_id for r in got if r.doc_id in (0, 1, 2, 3, 4, 10, 11))
    kept = near_dup.deduplicated(hostile_docs)
    assert kept.columns == hostile_docs.columns
    left = kept.collect()
    assert sum((r.text or "").startswith(hostile.PROSE) for r in left) == 1
    assert sum(not (r.text or "").strip(". \n\t\x00\x01") for r in left) == 7  # wordless texts stay
    assert near_dup.near_duplicates(no_docs).count() == near_dup.deduplicated(no_docs).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]
    star = [("hub", f"leaf{i}") for i in range(100)]
    pairs = chain + star + [("x", "x"), (None, "y"), ("hub", "leaf1")]
    got = components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert len(got) == 201 + 101 and len({r.root for r in got}) == 2
    assert len({r.root for r in got if r.node.startswith("c")}) == 1
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
