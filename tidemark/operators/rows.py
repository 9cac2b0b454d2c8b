"""Filters, projections, lookups and pages over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ranking import chunked, index_sorted
from tidemark.operators.skew import join_unique


def is_live(soft_delete: str | None) -> Column:
    return F.col(soft_delete).isNull() if soft_delete else F.lit(True)


def live(df: DataFrame, soft_delete: str | None) -> DataFrame:
    return df.filter(is_live(soft_delete)) if soft_delete else df


def live_keys(df: DataFrame, pk: str, soft_delete: str | None) -> DataFrame:
    return live(df, soft_delete).select(pk)


def lookup(keys: DataFrame, key: str, table: DataFrame, pk: str, soft_delete: str | None) -> DataFrame:
    """Each wanted key with ``status`` found / deleted / missing. A deleted row counts as absent."""
    gone = F.col(soft_delete).isNotNull() if soft_delete else F.lit(False)
    state = table.select(F.col(pk).alias("_pk"), gone.alias("_gone"))
    status = F.when(F.col("_pk").isNull(), "missing").when(F.col("_gone"), "deleted").otherwise("found")
    return join_unique(keys, state, key, "_pk").withColumn("status", status).drop("_pk", "_gone")


def page(df: DataFrame, pk: str, soft_delete: str | None, limit: int, after=None) -> DataFrame:
    """Live rows after a key, in key order: a bounded heap per task, never a full sort."""
    rows = live(df, soft_delete)
    if after is not None:
        rows = rows.filter(F.col(pk) > F.lit(after))
    return rows.orderBy(pk).limit(limit)


def page_end(page_rows: DataFrame, pk: str, limit: int) -> DataFrame:
    """``next_after``: the last key of a full page, else NULL."""
    return page_rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.when(F.count(F.lit(1)) == limit, F.max(pk)).alias("next_after"),
    )


def page_directory(df: DataFrame, pk: str, soft_delete: str | None, size: int) -> DataFrame:
    """First key, last key and row count of every page; each row lies in exactly one page."""
    indexed = index_sorted(live_keys(df, pk, soft_delete), [pk])
    total = indexed.agg(F.max("idx")).first()[0]
    # only the two ends of every page are shuffled
    ends = indexed.filter(((F.col("idx") - 1) % size == 0) | (F.col("idx") % size == 0) | (F.col("idx") == total))
    return chunked(ends, size, out="page").groupBy("page").agg(
        F.min(pk).alias("first_key"), F.max(pk).alias("last_key"),
        (F.max("idx") - F.min("idx") + 1).alias("n_rows"))


def latest_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``order``. Spark cuts every partition to
    ``n`` per group before the shuffle, so a hot group arrives as tasks x n rows."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))).cast("bigint")
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
