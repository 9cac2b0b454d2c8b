"""Counts, tallies, folds and lists over tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ranking import chunked, index_by_integer
from tidemark.operators.rows import is_live


def row_counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows per group, soft-deleted ones included."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("row_count"))


def live_and_total(df: DataFrame, soft_delete: str | None, *more: Column) -> DataFrame:
    """One row of counts, with any further aggregates of the same scan."""
    return df.agg(F.count_if(is_live(soft_delete)).alias("live_rows"), F.count(F.lit(1)).alias("total_rows"), *more)


def owned_counts(owners: DataFrame, owner_id: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """One count column per child table; owners without children get 0. The aggregate runs
    before the join, so the join sees one row per owner."""
    out = owners
    for name, (rows, fk) in children.items():
        n = rows.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
        out = (
            out.join(n, F.col(owner_id) == F.col("_fk"), "left")
            .withColumn(name, F.coalesce("_n", F.lit(0))).drop("_fk", "_n")
        )
    return out


def op_tallies(log: DataFrame) -> DataFrame:
    """What a batch did per entity: tallies by op and the span of versions."""
    def tally(op):
        return F.count_if(F.col("op") == op)

    return log.groupBy("entity").agg(
        tally("insert").alias("inserted"), tally("update").alias("updated"),
        tally("delete").alias("deleted"),
        F.min("version").alias("first_version"), F.max("version").alias("last_version"))


def quota_usage(owners: DataFrame, owner_id: str, rows: DataFrame, fk: str, counted: Column, limit: int) -> DataFrame:
    """Counted rows of every owner against a limit; full owners are refused the next one, and
    owners with nothing have all of it left."""
    used = F.col("used")
    return owned_counts(owners.select(owner_id), owner_id, used=(rows.filter(counted), fk)).select(
        F.col(owner_id).alias(fk), "used",
        F.greatest(F.lit(0), F.lit(limit) - used).cast("bigint").alias("remaining"),
        F.when(used >= limit, "quota_exceeded").otherwise("ok").alias("status"))


def privacy_fold(rows: DataFrame, group: str, private: Column) -> DataFrame:
    """A group is private if any member is; mixed groups are flagged."""
    return rows.groupBy(group).agg(
        F.bool_or(private).alias("is_private"),
        (F.bool_or(private) & ~F.bool_and(private)).alias("is_mixed"),
        F.count_if(private).alias("n_private"), F.count(F.lit(1)).alias("n_members"))


def listed(rows: DataFrame, owner: str, item: str, created_seq: str, size: int = 1000) -> DataFrame:
    """Items of every owner as lists in creation order, ``size`` items to a list.

    An owner may hold any share of the rows, so one list per owner is no safe shape: the
    lists are numbered and each is bounded. Reading an owner's lists by number gives the
    whole listing.
    """
    indexed = chunked(
        index_by_integer(rows.select(owner, item, created_seq), created_seq, by=[owner]),
        size, out="list_no")
    pairs = F.array_sort(F.collect_list(F.struct("idx", item)))
    return indexed.groupBy(owner, "list_no").agg(
        F.transform(pairs, lambda p: p[item]).alias("items"))


def last_per_group(rows: DataFrame, group: str, order: str, **columns: str) -> DataFrame:
    """Columns of the row with the highest ``order`` per group, for fixed-width columns:
    they stay in a hash aggregate with map-side combine."""
    return rows.groupBy(group).agg(
        *[F.max_by(source, order).alias(name) for name, source in columns.items()])
