"""Token ids by the tokenizers library, one call of its model per new piece of text.

A tokenizer normalises a text, splits it into pieces by a pattern and merges the bytes of each piece on its own, so
the ids of a piece do not depend on its neighbours. Texts are cut into runs at white space, where both kinds of
tokenizer cut in any case; a worker remembers the ids of runs and pieces (REMEMBERED at most of each) and hands
only new pieces to the library's model. Texts are cut first at the tokenizer's added tokens, which have ids of their own.
The ids are those of encoding the whole text with the library.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

REMEMBERED = 700_000  # runs, and pieces, that a worker keeps: some 200 MB
#: The splitting patterns of both kinds of tokenizer (fixed values).
SPACED_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space next to white space, which may share a piece.
_TOUCHING = re.compile(r"\s\s").search

_LOADED: dict[tuple[int, str], Encoder] = {}


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_CHARACTER = _alphabet()


class Encoder:
    """ids(texts) as little-endian unsigned 16- or 32-bit numbers in bytes."""

    def __init__(self, definition: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.spaced = kind == "spaced"
        self.split = regex.compile(SPACED_PIECE if self.spaced else PLAIN_PIECE).findall
        self.runs: dict = {}
        added = json.loads(definition)["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in what is beside them are not supported")
        self.added = {t["content"]: np.array([t["id"]], self.dtype).tobytes() for t in added if t["content"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if added else lambda text: [text]
        self.known: dict[str, bytes] = {}

    def pieces(self, run: str | bytes) -> list[str]:
        text = run if self.spaced else run.decode()
        if self.normalizer is not None and not text.isascii():  # runs of the plain kind are lowered ASCII already
            text = self.normalizer.normalize_str(text)
        if text.isalpha() or (self.spaced and text[1:].isalpha() and text[0] == " "):  # letters are one piece
            return [text]
        return self.split(text)

    def _cut(self, text: str) -> list:
        """Runs of a text, keys of ``runs``. The plain kind drops white space and letter case. The spaced kind cuts
        before each blank and line break that stands alone; a run stands for itself behind a blank, unless it
        begins with a line break or is the text's first (marked by NUL and a blank)."""
        if not self.spaced:
            return text.encode().lower().split()
        if _TOUCHING(text):
            return ["\0 " + text]
        runs = text.replace("\n", " \n").split(" ")
        runs[0] = "\0 " + runs[0]
        return runs

    def _text_of(self, run: str | bytes) -> str | bytes:
        if not self.spaced or run[:1] == "\n":
            return run
        return run[2:] if run[:2] == "\0 " else " " + run

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            spelled = piece.encode().decode("latin-1").translate(_CHARACTER)
            ids = self.known[piece] = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def _learn(self, texts: list[list]) -> None:
        """Ids of all runs of the given texts; afterwards every one of them is known."""
        runs = set().union(*texts)
        new = runs.difference(self.runs)
        if len(self.runs) + len(new) > REMEMBERED:
            self.runs.clear()
            new = runs
        for run in new:
            self.runs[run] = b"".join(map(self._piece, self.pieces(self._text_of(run))))

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        out = []
        for at in range(0, len(texts), 64):
            some = [self._cut(t) for t in texts[at : at + 64]]
            self._learn(some)
            out += [b"".join(map(self.runs.__getitem__, runs)) for runs in some]
            if self.spaced:
                for runs in some:
                    self.runs.pop(runs[0], None)  # a text's first run will hardly come again
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without an end id."""
        marked = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        parts = {i: self.apart(texts[i]) for i in marked}  # text, added token, text, ...
        plain = [t for i, t in enumerate(texts) if i not in parts] + [t for i in marked for t in parts[i][::2]]
        got = iter(self._plain_ids(plain))
        out = [None if i in parts else next(got) for i in range(len(texts))]
        for i in marked:
            out[i] = b"".join(next(got) if k % 2 == 0 else self.added[t] for k, t in enumerate(parts[i]))
        return out

    def rest(self) -> None:
        """Between tasks only runs are remembered, so that an idle worker is small."""
        self.known.clear()


def encoder(definition: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content; ``kind`` is ``spaced`` (byte-level, blanks belong to
    the word behind) or ``plain`` (white space and case dropped)."""
    key = (hash(definition), kind)
    if key not in _LOADED:
        _LOADED[key] = Encoder(definition, kind)
    return _LOADED[key]
