"""Language, quality and language-model scores: held-out accuracy, base scores by hand, hostile tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import hostile
import numpy as np
import pytest

from tidemark.llm import language, mixing_lm, quality, sampling

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_folds(spark, docs):
    got = docs.select("doc_id", sampling.fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == crc(r.doc_id) % 5 for r in got)


def test_language_accuracy_and_blindness(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identified(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and {r.doc_id for r in held} == {i for i in truth if crc(i) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    model = language.fit(docs.where(sampling.fold("doc_id", 5) != 0))
    assert [sorted(m) for m in model.members] == [["de", "en"], ["es", "fr"]] and len(model.duels) == 2
    blind = docs.withColumnsRenamed({"lang": "x"}).withColumn("lang", docs.source)
    assert {(r.doc_id, r.lang_pred) for r in language.identify(blind, model).collect()} == {(r.doc_id, r.lang_pred) for r in got}


def test_language_of_hostile_rows(spark, hostile_docs, no_docs):
    got = language.identified(hostile_docs).collect()
    assert len(got) == len(hostile.rows())
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3, 11)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 8)} == {"en"}
    assert language.identified(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(hostile_docs, None).collect()} == {"und"}


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = [("a", "same text")] * 500 + [("a", f"t{i}") for i in range(200)] + [("b", f"u{i}") for i in range(5)]
    got = sampling.text_sample(spark.createDataFrame(rows, "k string, text string"), "k", 100).collect()
    count = Counter(r.k for r in got)
    assert count["a"] == 50 and count["b"] == 5 and len(set(got)) == len(got)


def test_quality_accuracy_and_bounds(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.scores(docs, quality.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if crc(r.doc_id) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_of_hostile_rows(spark, docs, hostile_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, 0), (8, 1, 1), (6, 0, None), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(hostile_docs, labels)
    got = quality.scores(hostile_docs, model).collect()
    assert len(got) == len(hostile.rows()) and all(r.score == 0 and r.predicted == 0 for r in got if r.doc_id in (0, 1))
    assert quality.fit(hostile_docs, labels.limit(0)) is None and quality.fit(no_docs, labels) is None
    assert quality.scores(hostile_docs, None, keep=True).count() == len(hostile.rows())
    assert quality.scores(hostile_docs, model, keep=True).columns == hostile_docs.columns
    assert quality.scores(no_docs, model).count() == 0


def test_neighbour_votes_equal_all_cosines():
    rng = np.random.default_rng(2)
    x = rng.random((300, 2 * quality.BUCKETS + 4)).astype(np.float32)
    x[:, 200:] *= rng.random((300, 2 * quality.BUCKETS - 196)) > 0.9
    model = quality.Model(x, (np.arange(300) % 3 > 0).astype(int))
    new = x[:20] + 0.1
    z = model.weighted(new.copy()) @ model.topics
    for row, score in zip(z, model.score(new.copy())):
        cosine = model.near @ row / np.linalg.norm(row)
        top = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.maximum(cosine[top], 0) ** quality.POWER
        assert abs((vote * model.label[top]).sum() / vote.sum() - score) < 1e-3


def words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w] + [None]


def test_base_scores_by_hand_and_model_beats_order_zero(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing_lm, "FREQUENT", 500)  # the rest goes through the join
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if crc(i) % 5 != 1 for w in words(t))
    total, below = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    got = {r.doc_id: r for r in mixing_lm.scored(docs).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        w = words(texts[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 5 == 1, len(w), sum(x in count for x in w), total)
        assert abs(r.base_score - sum(math.log10(count.get(x, 0) + 0.5) - below for x in w)) < 1e-6 * abs(r.base_score)
        assert abs(r.score + r.bits_per_byte * (len(texts[i].encode()) + 1) * math.log10(2)) < 1e-6 * abs(r.score)
    held = [r for r in got.values() if r.held_out]
    bytes_ = Counter(b for i, t in texts.items() if crc(i) % 5 != 1 for b in t.encode())
    order0 = -sum(n / sum(bytes_.values()) * math.log2(n / sum(bytes_.values())) for n in bytes_.values())
    assert np.mean([r.bits_per_byte for r in held]) < 0.75 * order0


def test_probabilities_of_next_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    n = sum(mixing_lm.SLOTS)
    model = mixing_lm.Model(rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 3, n).astype(np.int32), [b"abc abd abe " * 20])
    for before in (0, 0x6162, 0x616263):
        gram = (np.int64(before) << 8) | np.arange(256, dtype=np.int64)
        assert abs((2.0 ** -model.cost(gram)).sum() - 1) < 1e-3


def bit_counts(texts):
    counts = np.zeros((2, sum(mixing_lm.SLOTS)), np.int32)
    for t in texts:
        for _, at, bit in mixing_lm.slots(mixing_lm.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))):
            for value in (0, 1):
                np.add.at(counts[value], at[bit == value], 1)
    return counts


def test_mixing_learns_from_every_training_text(spark):
    """Scores are those of a model that one process learns from all training texts: many, long, empty, repeated."""
    rng = np.random.default_rng(4)
    short = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)) for _ in range(400)]
    long = [" ".join(str(x) for x in rng.integers(0, 10**6, 2500)) for _ in range(8)]
    rows = list(enumerate([*short, *long, "", None, short[0], short[0]]))
    train = [(t or "").encode() for i, t in rows if crc(i) % 5 != 1]
    assert len(train) > 320 and any(len(t) > 8192 for t in train) and any(len(t or "") > 8192 for i, t in rows if crc(i) % 5 == 1)
    model = mixing_lm.Model(*bit_counts(train), train)
    got = mixing_lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = np.frombuffer((rows[r.doc_id][1] or "").encode(), np.uint8)
        cost = model.cost(mixing_lm.grams(data, np.array([0, len(data)]))).sum()
        assert abs(r.score + cost * math.log10(2)) < 1e-5 * abs(r.score)


def test_mixing_weights_cost_least():
    """Bit after bit, every one as often as it comes: no other weights near cost the texts less."""
    texts = [b"abc abd abe " * 20, b"the cat sat on the mat, the dog on the log; 1 2 3 4", b"abc abd abe " * 20, b""]
    counts = bit_counts(texts)
    model = mixing_lm.Model(*counts, texts)
    inputs, gates, bits = [], [], []
    for t in texts:
        for place, at, bit in mixing_lm.slots(mixing_lm.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))):
            for spots, y in zip(at, bit):
                pairs = [(int(counts[0, s]) - (y == 0), int(counts[1, s]) - (y == 1)) for s in spots]
                odds = [math.log((o + 0.05) / (z + 0.05)) for z, o in pairs]
                inputs.append(odds + [a * min(math.log2(z + o + 1) / 10, 1) for a, (z, o) in zip(odds, pairs)] + [0.3])
                gates.append(max([k + 1 for k, (z, o) in enumerate(pairs) if z + o > 0], default=0) * 8 + place)
                bits.append(y)
    inputs, gates, sign = np.array(inputs), np.array(gates), np.where(np.array(bits) == 1, -1, 1)

    def cost(weight):
        start = np.array([0.25] * 5 + [0] * 6)
        return np.logaddexp(0, sign * (inputs * weight[gates]).sum(axis=1)).sum() + mixing_lm.PRIOR / 2 * ((weight - start) ** 2).sum()

    rng, least = np.random.default_rng(5), cost(model.weight)
    assert least < cost(np.tile([0.25] * 5 + [0.0] * 6, (mixing_lm.GATES, 1)))
    for gate in np.unique(gates):
        away = np.zeros_like(model.weight)
        away[gate] = rng.normal(size=away.shape[1])
        assert cost(model.weight + 0.05 * away) > least and cost(model.weight - 0.05 * away) > least


def test_mixing_of_hostile_rows(spark, hostile_docs, no_docs):
    got = mixing_lm.scored(hostile_docs).collect()
    assert len(got) == len(hostile.rows())
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (0, 1, 2))
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in got)
    assert mixing_lm.scored(no_docs).count() == 0
    only_held = hostile_docs.where(sampling.fold("doc_id", 5) == 1)
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in mixing_lm.scored(only_held).collect())
