"""Bulk create, update and delete from payload tables.

A change takes effect in the order of ``row_pos``. Like every write here, each operator
returns the new table and the log entries it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.batches import Mutation, log_rows
from tidemark.operators.feed import entity_next
from tidemark.operators.generate import check_new_keys, generate, new_keys
from tidemark.operators.ranking import index_unique
from tidemark.operators.skew import fits_broadcast, join_unique
from tidemark.operators.validation import (
    first_failure, request_size, validate,
)
from tidemark.schema import Table
from tidemark.session import pin


class InvalidBatch(ValueError):
    """A bulk request was refused as a whole."""


def check_positions(requests: DataFrame) -> None:
    """Refuses a request whose positions do not order it: one is null, or given twice."""
    bad = requests.groupBy("row_pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR row_pos IS NULL").orderBy("row_pos").first()
    if bad and bad["row_pos"] is None:
        raise InvalidBatch(f"missing_position: {bad['n']} rows have none")
    if bad:
        raise InvalidBatch(f"repeated_position: rows[{bad['row_pos']}] is given {bad['n']} times")


def read_batch(payloads: DataFrame, table: Table, rows: DataFrame, parents=None,
               row_limit: int | None = None) -> tuple[DataFrame, int]:
    """The payloads of a good batch as stored typed fields, and how many they are. A batch that is too large,
    repeats or lacks a position, or holds a bad row is refused as a whole."""
    read = pin(validate(payloads, table, parents, given=True), "payloads")  # parsed once, read from here on
    size = request_size(read, rows.count() if table.max_rows is not None else 0, table.max_rows, row_limit).first()
    if size["status"] != "ok":
        raise InvalidBatch(f"{size['status']}: {size['rows_after']} rows")
    check_positions(read)
    worst = first_failure(read).first()
    if worst["n_bad"]:
        raise InvalidBatch(f"{worst['error_code']}: {worst['message']}")
    return read, size["n_rows"]


def create_rows(spark: SparkSession, table: Table, rows: DataFrame, log: DataFrame, payloads: DataFrame,
                seed, batch_ts: Column, parents=None, row_limit: int | None = None) -> Mutation:
    """One new row per payload: given fields as given, the rest generated. All or nothing.

    Rows are numbered 0..n-1 in the order of ``row_pos``, whatever numbers those are (ascending ids
    with gaps will do); the number gives a row its key, its draws and its version.
    """
    read, n = read_batch(payloads, table, rows, parents, row_limit)
    first = entity_next(rows, log, table.name)
    check_new_keys(new_keys(spark, table, n, seed), rows, table.pk, n)
    placed = index_unique(read.drop("payload", "error_code", "error_field", "message"), "row_pos")
    numbered = placed.withColumn("i", F.col("idx") - 1).drop("row_pos", "idx")
    made = generate(spark, table, n, seed, batch_ts, parents, numbers=numbered)
    given = {f.name for f in table.writable}

    def final(c: str) -> Column:
        if c == "version":
            return (F.col("i") + F.lit(first)).cast("bigint")
        if c in given:
            return F.when(F.col(f"_has_{c}"), F.col(f"_given_{c}")).otherwise(F.col(c))
        return F.col(c)

    new = made.select(*[final(c).alias(c) for c in table.columns])
    return Mutation(rows.select(table.columns).unionByName(new),
                    log_rows(new, table.name, F.col(table.pk), "insert", batch_ts),
                    {"entity": table.name, "inserted": n, "first_version": first if n else None,
                     "last_version": first + n - 1 if n else None})


def _targets(rows: DataFrame, table: Table, live_only: bool) -> DataFrame:
    gone = F.col(table.soft_delete).isNotNull() if table.soft_delete and live_only else F.lit(False)
    return rows.filter(~gone).select(F.col(table.pk).alias("_pk"))


def outcomes(requests: DataFrame, table: Table, rows: DataFrame, live_only: bool) -> DataFrame:
    """Requests (row_pos, key, ..) with ``error_code`` not_found where the row is absent."""
    joined = join_unique(requests, _targets(rows, table, live_only), "key", "_pk")
    return joined.withColumn("error_code", F.when(F.col("_pk").isNull(), "not_found")).drop("_pk")


def update_outcomes(requests: DataFrame, table: Table, rows: DataFrame, parents=None) -> DataFrame:
    """Requests (row_pos, key, payload) with the code of what is wrong with each, if anything:
    the target must be live and the payload good."""
    found = outcomes(requests, table, rows, live_only=True).withColumnRenamed("error_code", "_absent")
    checked = validate(found, table, parents, given=True)
    return checked.withColumn("error_code", F.coalesce("_absent", "error_code")).drop(
        "_absent", "error_field", "message")


def _beside(rows: DataFrame, last: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows' changes, at most one for each stored request: broadcast if those are few and small. What a change
    carries came in its request's key and payload, so their bytes bound it."""
    carried = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("key", "payload") if c in judged.columns]
    n, size = judged.agg(F.count(F.lit(1)), F.sum(sum(carried, F.lit(0)))).first()
    return F.broadcast(last) if fits_broadcast(rows, n, size or 0) else last


def update_rows(table: Table, rows: DataFrame, log: DataFrame, requests: DataFrame, batch_ts: Column,
                parents=None) -> tuple[Mutation, DataFrame]:
    """Apply partial payloads to live rows: only the given fields change.

    Every accepted request takes one version and one log entry, in ``row_pos`` order; the positions may be any
    integers, but a null or a repeated one refuses the whole request. When
    several requests name one row, each field ends at its last given value: a max_by per
    field, combined map-side, so a row updated by a third of the requests is no hot spot.
    """
    judged = pin(update_outcomes(requests, table, rows, parents), "judged")  # read from here on
    check_positions(judged)
    base = entity_next(rows, log, table.name) - 1
    accepted = index_unique(judged.filter(F.col("error_code").isNull()).drop("error_code"), "row_pos")
    accepted = accepted.withColumn("version", F.col("idx") + F.lit(base))
    last = accepted.groupBy("key").agg(
        F.max("version").alias("_version"),
        *[agg for f in table.writable for agg in (
            F.max_by(F.col(f"_given_{f.name}"),
                     F.when(F.col(f"_has_{f.name}"), F.col("row_pos"))).alias(f"_new_{f.name}"),
            F.bool_or(f"_has_{f.name}").alias(f"_set_{f.name}"))])
    writable = {f.name for f in table.writable}
    updated = table.autos("updated")

    def final(c: str) -> Column:
        if c == "version":
            return F.coalesce("_version", "version")
        if c in writable:
            return F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c))
        if c in updated:
            return F.when(F.col("_version").isNotNull(), batch_ts).otherwise(F.col(c))
        return F.col(c)

    beside = _beside(rows, last, judged)
    after = rows.join(beside, F.col(table.pk) == F.col("key"), "left").select(
        *[final(c).alias(c) for c in table.columns])
    entries = log_rows(accepted, table.name, F.col("key"), "update", batch_ts)
    return Mutation(after, entries, {"entity": table.name}), judged.select(*requests.columns, "error_code")


def delete_rows(table: Table, rows: DataFrame, log: DataFrame, requests: DataFrame,
                batch_ts: Column) -> tuple[Mutation, DataFrame]:
    """Soft-delete rows by key. The row must exist but may be deleted already: a second delete
    succeeds and is logged again. Positions as for updates."""
    if not table.soft_delete:
        raise ValueError(f"not_supported: '{table.name}' has no soft-delete field")
    judged = pin(outcomes(requests, table, rows, live_only=False), "judged")  # read from here on
    check_positions(judged)
    base = entity_next(rows, log, table.name) - 1
    accepted = index_unique(judged.filter(F.col("error_code").isNull()), "row_pos")
    accepted = accepted.withColumn("version", F.col("idx") + F.lit(base))
    last = accepted.groupBy("key").agg(F.max("version").alias("_version"))
    hit = F.col("_version").isNotNull()
    after = rows.join(_beside(rows, last, judged), F.col(table.pk) == F.col("key"), "left").select(*[
        (F.coalesce("_version", "version") if c == "version"
         else F.when(hit, batch_ts).otherwise(F.col(c)) if c == table.soft_delete
         else F.col(c)).alias(c) for c in table.columns])
    entries = log_rows(accepted, table.name, F.col("key"), "delete", batch_ts)
    return Mutation(after, entries, {"entity": table.name}), judged
