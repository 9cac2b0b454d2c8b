"""Periodic runs against every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import hostile
import pytest
from tidemark.llm import runs


def every_run(words):
    """All runs (start, length, period), by trying every period."""
    stretches = {}
    for q in range(1, len(words) // 3 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + q
                if length >= max(24, 3 * q):
                    stretches.setdefault((start, length), q)  # the smallest period comes first
                start = None
    return [(s, n, q) for (s, n), q in stretches.items()]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(every_run(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def corpus():
    draw, texts = random.Random(8), {}
    for doc in range(420):
        n = draw.choice((0, 3, 24, 40, 130, 400, 900))
        words = [f"w{draw.randrange(draw.choice((1, 2, 4, 300)))}" for _ in range(n)]
        for _ in range(draw.randrange(4) if n > 5 else 0):  # repeat a stretch, with a period up to a third of the text
            at, q = draw.randrange(n - 2), draw.randrange(1, n // 3 + 1)
            length = draw.randrange(n - at)
            words[at : at + length] = [words[min(at + i % q, n - 1)] for i in range(length)]
        texts[doc] = draw.choice((" ", "\n", " \t")).join(words)
    return texts


@pytest.mark.parametrize("spread, tile", [(1 << 20, 1 << 13), (50, 64)])
def test_equal_to_every_period(spark, monkeypatch, spread, tile):
    monkeypatch.setattr(runs, "SPREAD", spread)
    monkeypatch.setattr(runs, "TILE", tile)
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r) for r in runs.periodic_runs(df, change=True).collect()}
    want = {i: expected(i, t) for i, t in texts.items()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 60


def test_a_word_over_and_over_takes_no_quadratic_time(spark):
    df = spark.createDataFrame([(1, "again " * 200_000), (2, "one " + "two three " * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in runs.collapsed(df)[0].collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, bytes(got[1].collapsed)) == (1, 0, 200_000, 1, b"again")
    assert (got[2].start, got[2].length, got[2].period, bytes(got[2].collapsed)) == (1, 100_000, 2, b"one two three")


def test_hostile_rows(spark, hostile_docs, no_docs):
    got = sorted((tuple(r) for r in runs.periodic_runs(hostile_docs, change=True).collect()), key=str)
    short = {i: r for i, r in enumerate(hostile.rows()) if len(r[1] or "") < 10_000}
    assert len(got) == len(hostile.rows())
    want = sorted((expected(r[0], r[1]) for r in short.values()), key=str)
    assert [r for r in got if r[0] not in (8, 9)] == want
    assert runs.periodic_runs(no_docs).count() == 0
