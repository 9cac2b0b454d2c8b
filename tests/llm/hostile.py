"""A table with what tables hold: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, node string, h string, kind string, score string, "
          "key string, ids string, start string, task string, uid string, label string, spans string, words string")

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
PROSE = ("the quick brown fox jumps over the lazy dog near the river bank while seven old men watch the boats come in "
         "and talk about the weather of the last few days in this part of the country")


def rows():
    texts = [None, "", " \n\t ", "...", "one", PROSE, PROSE, PROSE + " today", LONG, LONG + " end", "mail me at jo.doe@example.org or +1 (555) 010-9999 now", "\x00\x01"]
    out = []
    for i, text in enumerate(texts):
        extra = [None if i % 3 else "x"] * 12
        out.append((i, text, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None, *extra))
    return out + [out[5], out[5], out[1], (None, PROSE, None, None, None, *[None] * 12), (None, None, None, None, None, *[None] * 12)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
