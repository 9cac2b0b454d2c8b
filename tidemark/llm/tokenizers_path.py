"""Definitions of public tokenizers, read on the driver."""

from __future__ import annotations


def definition(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()
