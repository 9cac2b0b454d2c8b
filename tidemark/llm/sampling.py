"""Bounded samples of labelled texts to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def text_sample(rows: DataFrame, key: str, total: int) -> DataFrame:
    """At most ``total`` distinct texts of (key, text), in equal shares for the keys: those of lowest text hash.

    Copies of a text count once however many there are, so a hot text takes one place. Texts are hashed where
    they lie; only texts below a cut that follows from approximate distinct counts are shuffled.
    """
    hashed = rows.select(key, "text", F.xxhash64("text").alias("h"))
    sizes = {r[0]: r[1] for r in hashed.groupBy(key).agg(F.approx_count_distinct("h")).collect()}
    if not sizes:
        return rows.select(key, "text").limit(0)
    share = max(1, total // len(sizes))
    cut = {k: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 1.3 * (share + 30) / max(1, n)) * (1 << 64))) for k, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col(key))
    few = hashed.where(F.col("h") <= limit).groupBy(key, "h").agg(F.any_value("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    return few.withColumn("r", rank).where(F.col("r") <= share).select(key, "text")
