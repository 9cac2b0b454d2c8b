"""Words, shingles, weighted MinHash, token ids and bit packing against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bitpack, near_dup
from tidemark.llm.textblocks import blocks, counted, shingles, words
from tidemark.llm.tokenizers_path import definition
from tidemark.llm.tokens import encoder

ODD = ["", " ", "\n", "one", "a  b\n\n c\t\td  ", "don't I'll we've\u00a0x\u2003y \u3000z", "\u00e9,e\u0301! \u03a9 \u03a3\u0391\u03a3 \u0130stanbul \ufb01",
       "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8 \u0939\u093f\u0928\u094d\u0926\u0940, \u05e2\u05d1\u05e8\u05d9\u05ea", "<|endoftext|> <|startoftext|>a", "a7b 7 77 \uff17 \u00bd",
       "\x00\x1c\x85 x\x0by\r\n\r\n", "'s 't it's IT'S", "\U0001f44d\U0001f3fd a\u200db", "x  \n  y", "a\t\n", "a\t\n\tb c\r\nd", "a \tb\t c", "a\n\u3000b", "token token, TOKEN!"]


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    low = re.sub("[\u00c0-\u00de]", lambda m: m[0] if m[0] == "\u00d7" else chr(ord(m[0]) + 32), low)
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def test_words_and_shingles_follow_the_definition():
    texts = [*ODD, None, "One two, three four FIVE six!", "one two three four five SIX", "\u00c9t\u00e9 \u00e9t\u00e9", "long " * 5000]
    seen = {}
    for limit in (64, 1 << 20):
        for lo, hi, data, ends in blocks(pa.array(texts), limit):
            hashes, at = words(data, ends)
            values, doc = shingles(hashes, at, 5)
            for i in range(lo, hi):
                want = plain_words(texts[i] or "")
                got = hashes[at[i - lo] : at[i - lo + 1]].tolist()
                assert len(got) == len(want)
                for w, h in zip(want, got):
                    assert seen.setdefault(w, h) == h
                runs = [tuple(want[k : k + 5]) for k in range(len(want) - 4)] or ([tuple(want)] if want else [])
                for r, h in zip(runs, values[doc == i - lo].tolist(), strict=True):
                    assert seen.setdefault(r, h) == h
    assert len(set(seen.values())) == len(seen)


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 44, 300, dtype=np.uint64)
    weight = rng.integers(1, 9, 300).astype(float)
    weight[:20] = 0.25
    pairs = []
    for share in (0.1, 0.4, 0.8):
        other, w = base.copy(), weight.copy()
        cut = int(300 * share)
        other[:cut] = rng.integers(0, 1 << 44, cut, dtype=np.uint64)
        w[cut : cut + 30] *= 3
        pairs.append((other, w))
    sets = [(base, weight), *pairs, (base[:1], weight[:1]), (base[:0], weight[:0])]
    element, w = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    signature, present = near_dup.dart_minhash(element, doc, w, len(sets), 4096)
    assert present.tolist() == [True] * 5 + [False]
    one = dict(zip(base.tolist(), weight))
    for i, (other, v) in enumerate(pairs, 1):
        two = dict(zip(other.tolist(), v))
        keys = one.keys() | two.keys()
        true = sum(min(one.get(k, 0), two.get(k, 0)) for k in keys) / sum(max(one.get(k, 0), two.get(k, 0)) for k in keys)
        assert abs((signature[0] == signature[i]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 4096) + 1e-3
    alone, _ = near_dup.dart_minhash(base, np.zeros(300, int), weight, 1, 4096)
    assert (alone[0] == signature[0]).all()  # the same whatever else is in the block


def test_counted_keeps_documents_apart():
    element, doc, count = counted(np.array([5 << 20, 5 << 20, 7 << 20, 5 << 20], np.uint64), np.array([0, 0, 0, 2]), 3)
    assert list(zip(doc.tolist(), element.tolist(), count.tolist())) == [(0, 5, 2), (0, 7, 1), (2, 5, 1)]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "plain")])
def test_ids_equal_the_library(name, kind, monkeypatch):
    from tokenizers import Tokenizer

    import tidemark.llm.tokens as tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 500)  # forgets on the way
    draw = random.Random(3)
    letters = [chr(i) for i in [*range(1, 0x250), 0x300, 0x301, 0x2003, 0x3000, 0x200B, 0x4E00, 0x1F600, 0x93F]] + [" "] * 60 + ["\n"] * 10
    texts = ODD + ["".join(draw.choices(letters, k=50)) for _ in range(400)] + ["w" * 3000]
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof text|>", "<|", " ", "a", "Bee ", "\n", "é", "  "]
    texts += ["a <|endoftext|> b"] + ["".join(draw.choices(added, k=draw.randrange(1, 9))) for _ in range(300)]
    tool, library = encoder(definition(name), kind), Tokenizer.from_str(definition(name))
    for text, raw in zip(texts, tool.ids(texts)):
        assert np.frombuffer(raw, tool.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 24, 31, 32])
def test_bit_packing_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    payload = bitpack.pack(ids, width)
    assert len(payload) == -(-1000 * width // 8)
    for first, count in ((0, 1000), (0, 0), (1, 1), (7, 13), (993, 7), (500, 499)):
        assert (bitpack.unpack(payload, width, first, count) == ids[first : first + count]).all()


def test_width_is_the_least_that_holds_the_vocabulary():
    assert [bitpack.width_for(n) for n in (1, 2, 3, 256, 257, 50257, 1 << 16, (1 << 16) + 1)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_duplicates_have_one_word_table():
    assert Counter(plain_words("A a, A.")) == {"a": 3}
