"""Packing and bit-packed files: every id once, in its place."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bitpack, packing
from tidemark.llm.tokenizers_path import definition
from tidemark.session import scratch_path


def library_ids(name, texts, end):
    library = Tokenizer.from_str(definition(name))
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize("sizes, targets", [
    ([700, 300], None), ([1, 1, 1], None), ([5000], None), ([10_000, 3, 0, 777, 1], None),
    ([700, 300, 500], [1.0, 1.0, 1.0]), ([9000, 40, 0, 600], [0.1, 0.5, 0.2, 0.0]), ([(1 << 40) + 7, 1 << 39, 12345], None)])
def test_rule_serves_all_and_keeps_proportions(sizes, targets):
    rule = packing.Rule(sizes, targets)
    total, length = sum(sizes), 64
    windows = -(-total // length)
    some = np.unique(np.concatenate([np.arange(min(windows, 300)), np.array([windows // 3, windows // 2, windows - 1])]))
    for w in some.tolist():
        at = np.full(len(sizes), min(w * length, total))
        after = np.full(len(sizes), min((w + 1) * length, total))
        q = np.arange(len(sizes))
        low, left = rule.served(at, q)
        high, right = rule.served(after, q)
        assert low.sum() == at[0] and high.sum() == after[0] and (high >= low).all()
        assert ((right - left) == np.cumsum(high - low) - (high - low)).all()  # queues lie side by side
        if targets is None:
            assert np.abs(low - at[0] * (np.array(sizes) / total)).max() <= np.log2(len(sizes)) + 2
    assert (rule.served(np.full(len(sizes), total), np.arange(len(sizes)))[0] == sizes).all()


def test_equal_targets_until_a_queue_runs_dry():
    rule = packing.Rule([6400, 640, 3200], [1, 1, 1])
    for ids in (192, 960, 1856):
        assert np.abs(rule.served(np.full(3, ids), np.arange(3))[0] - ids / 3).max() <= 3
    assert rule.served(np.array([1 << 20]), np.array([1]))[0][0] == 640


def check_pieces(rows, docs, length=2048):
    ids = dict(zip([d[0] for d in docs], library_ids("word_bpe_49k.json", [d[1] for d in docs], 1)))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
        whole = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(whole) and 0 < r.length <= length
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids[d])
    assert sorted(by_window) == list(range(len(by_window)))
    for w, pieces in by_window.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        size = sum(r.length for r in pieces)
        assert size == length if w < len(by_window) - 1 else size <= length
        assert {r.padded_to for r in pieces} == {size if size & (size - 1) == 0 else length}
    return by_window


def test_every_id_once_and_the_mixture_in_every_window(spark):
    docs = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(30 + i % 50)), f"s{0 if i % 3 else i % 5}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    windows = check_pieces(packing.pack(df, definition("word_bpe_49k.json")).collect(), docs)
    source = {d[0]: d[2] for d in docs}
    mixes = [Counter() for _ in windows]
    for w, pieces in windows.items():
        for r in pieces:
            mixes[w][source[r.doc_id]] += r.length
    for s in set(source.values()):
        share = [m[s] for m in mixes[:-1]]
        assert max(share) - min(share) <= 4


def test_targets_hold_while_queues_last(spark):
    docs = [(i, "some words of a document " * 20, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    windows = check_pieces(packing.pack(df, definition("word_bpe_49k.json"), targets={"a": 3, "b": 1}).collect(), docs)
    first = Counter()
    for r in windows[0]:
        first["ab"[r.doc_id % 2]] += r.length
    assert abs(first["a"] - 1536) <= 3


def test_hostile_rows(spark, hostile_docs, no_docs):
    import hostile

    rows = packing.pack(hostile_docs, definition("word_bpe_49k.json")).collect()
    want = sum(map(len, library_ids("word_bpe_49k.json", [r[1] for r in hostile.rows()], 1)))
    assert sum(r.length for r in rows) == want
    assert packing.pack(no_docs, definition("word_bpe_49k.json")).count() == 0
    path = scratch_path(spark, "ids")
    bitpack.write(hostile_docs, path, definition("byte_bpe_50k.json"))
    got = bitpack.digests(spark, path).collect()
    assert len(got) == len(hostile.rows())
    assert sum(r.n_tokens for r in got) == sum(map(len, library_ids("byte_bpe_50k.json", [r[1] for r in hostile.rows()], 0)))
    bitpack.write(no_docs, path + "-none", definition("byte_bpe_50k.json"))
    assert bitpack.digests(spark, path + "-none").count() == 0


def test_files_hold_the_ids_in_order(spark, monkeypatch):
    docs = [(977 * i % 1000, f"text {i} " * (i % 40), "s") for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(7)
    path = scratch_path(spark, "ids")
    monkeypatch.setattr(bitpack, "BLOCK_IDS", 512)
    bitpack.write(df, path, definition("byte_bpe_50k.json"))
    texts = dict((d[0], d[1]) for d in docs)
    ids = library_ids("byte_bpe_50k.json", [texts[i] for i in range(1000)], 0)
    before = 0
    for r, want in zip(sorted(bitpack.digests(spark, path).collect(), key=lambda r: r.doc_id), ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        before += len(want)
    flat = [x for want in ids for x in want]
    assert bitpack.ids_of(spark, path, 700, 5000).tolist() == flat[700:5700]
