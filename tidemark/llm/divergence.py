"""Quality rules: repetition counts, and the distance of a text's histograms from its language's.

Two histograms of a text are compared with references of its language by Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1): character classes, and the language's common words with one bin for all others.
References are sums over all documents of the language; a word is common if it is COMMON of the language's words
or more, so a language has at most 1 / COMMON of them. Texts without a language are compared with the whole corpus.
A histogram of few items is noise: a text's own and its language's have least numbers of items, and a comparison
passes without them. These are counts, not shares, so what else the corpus holds changes no verdict of a language.

DataFrame functions only. Arrays of words are handled within the row; only word counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin

COMMON, LEAST = 0.01, 5000  # share of a common word, words of a language that has a reference
NARROW = 4096  # most references that are broadcast, of 1 / COMMON words each
WINDOW = 5
LEAST_WORDS, REPEATED = 10, 20  # base rule: words, per cent of words in repeated windows
WORDS_GUARD, CHARS_GUARD = 50, 250  # least items of a histogram that is judged
WORD_LIMIT, CHAR_LIMIT = 0.45, 0.34
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ALL = ""  # name of the reference of the whole corpus; an empty lang is none


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often (and in whatever lambda) the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of WINDOW words which the text has twice or more."""
    def covered(runs: Column) -> Column:
        marked = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(marked, lambda m: F.filter(m, lambda e, i: (
            F.when(i > 0, F.get(m, i - 1)["h"] == e["h"]).otherwise(False)
            | F.when(i + 1 < F.size(m), F.get(m, i + 1)["h"] == e["h"]).otherwise(False))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.get(p, i + 1) - x, F.lit(WINDOW))).otherwise(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    runs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    counted = let(runs, lambda r: F.when(F.size(F.array_distinct(r)) < F.size(r), covered(r)).otherwise(0))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0)


def classes(column: str, symbols: Column) -> Column:
    """Character classes of a text without white space: capitals, digits, symbols, other ASCII marks, the bytes that
    non-ASCII characters take beyond their first, and the rest. They sum to the bytes."""
    without = lambda pattern: F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    return let(F.struct(without("[A-Z]").alias("upper"), without("[0-9]").alias("digits"), without(r"[!-/:-@\[-`{-~]").alias("marks"),
                        F.length(column).alias("n"), F.octet_length(column).alias("bytes")), lambda x: F.array(*[c.cast("double") for c in (
        x["upper"], x["digits"], symbols, x["marks"] - symbols, x["bytes"] - x["n"], x["n"] - x["upper"] - x["digits"] - x["marks"])]))


CLASSES = 6


def symbols_in(column: str) -> Column:
    return F.length(column) - F.length(F.translate(column, SYMBOLS, ""))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, words, the base columns, and the character classes ``chars`` of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(F.struct(words_of(F.col("text")).alias("w"), lines(F.col("text")).alias("l")), lambda x: F.struct(
        x["w"].alias("words"), F.array_join(x["w"], "").alias("joined"), repeated_words(x["w"]).alias("n_repeat"),
        (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).alias("n_dup")))
    found = rows.select("doc_id", "lang", both.alias("b")).select("doc_id", "lang", "b.words", "b.joined", "b.n_repeat", "b.n_dup")
    found = found.withColumn("n_symbols", symbols_in("joined"))  # none is white space
    return found.select(
        "doc_id", "lang", "words", F.size("words").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup").cast("long").alias("n_dup_lines"), F.col("n_repeat").cast("long").alias("n_repeat_words"),
        classes("joined", F.col("n_symbols")).alias("chars"))


def references(docs: DataFrame) -> DataFrame:
    """(ref, common, of_words, of_chars) of each language with LEAST words, and of the whole corpus.

    Both kinds of sums come from one table of distinct words with their counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    words = pin(rows.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    per_word = words.select("lang", "n", classes("word", symbols_in("word")).alias("c"))
    chars = pin(per_word.groupBy("lang").agg(F.sum("n").alias("total"), *[F.sum(F.col("n") * F.col("c")[i]).alias(f"c{i}") for i in range(CLASSES)]), "chars")
    total = chars.agg(F.sum("total")).first()[0] or 0
    kept = chars.where((F.col("total") >= LEAST) & (F.col("lang") != "")).select(F.col("lang").alias("ref"), "total")
    beside = F.broadcast(kept) if kept.count() <= NARROW else kept
    of_lang = words.withColumnRenamed("lang", "ref").join(beside, "ref")
    of_all = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("ref"), "word", "n", F.lit(total).cast("long").alias("total"))
    share = F.col("n") / F.col("total")
    common = (of_lang.select("ref", "word", "n", "total").unionByName(of_all).where(share >= COMMON)
              .groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("word", share.alias("share")))).alias("w")))
    sums = F.array(*[F.col(f"c{i}") for i in range(CLASSES)])
    whole = chars.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(CLASSES)]).select(F.lit(ALL).alias("ref"), sums.alias("c"))
    per_class = chars.select(F.col("lang").alias("ref"), sums.alias("c")).where("ref != ''").join(beside.select("ref"), "ref", "left_semi").unionByName(whole)
    unit = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    empty = F.array().cast("array<struct<word:string,share:double>>")
    got = per_class.join(common, "ref", "left").select("ref", unit(F.col("c")).alias("of_chars"), F.coalesce("w", empty).alias("w"))
    shares = F.transform("w", lambda x: x["share"])
    rest = F.greatest(1 - F.aggregate(shares, F.lit(0.0), lambda s, y: s + y), F.lit(0.0))
    return got.select("ref", F.transform("w", lambda x: x["word"]).alias("common"), F.concat(shares, F.array(rest)).alias("of_words"), "of_chars")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same bins, each summing to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, and the distances (null below their guards) of each row.

    Null and empty texts have zero counts and fail the base rule. Texts of a language with less than LEAST words pass both distances. Equal rows get equal results; columns other than
    doc_id, text and lang are not read. An empty table gives no row.
    """
    refs = pin(references(docs), "references")
    beside = F.broadcast(refs) if refs.count() <= NARROW else refs
    rows = counts(docs).withColumnRenamed("lang", "ref").join(beside, "ref", "left")  # an empty lang meets the whole corpus
    spread = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))  # every word has blanks of its own
    tally = let(spread, lambda s: F.transform("common", lambda w: (
        (F.octet_length(s) - F.octet_length(F.replace(s, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2))))
    bins = let(tally, lambda t: F.concat(t, F.array(F.col("n_words") - F.aggregate(t, F.lit(0.0), lambda a, x: a + x))))
    of_text = lambda a, n: F.transform(a, lambda x: x / n)
    n_chars = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    far_words = F.when((F.col("n_words") >= WORDS_GUARD) & (F.size("common") > 0), distance(of_text(bins, F.col("n_words")), F.col("of_words")))
    far_chars = F.when((n_chars >= CHARS_GUARD) & F.col("of_chars").isNotNull(), distance(of_text(F.col("chars"), n_chars), F.col("of_chars")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      far_words.alias("word_distance"), far_chars.alias("char_distance"))
    near = (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT) & (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT)
    return out.withColumn("kept", ~F.col("base_failed") & near).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "char_distance")
