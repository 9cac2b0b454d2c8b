"""Generating rows of declared tables at any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.draws import draw, field_value
from tidemark.operators.ranking import digits_for, index_by_digest
from tidemark.operators.skew import fits_broadcast
from tidemark.schema import Table, load_order

ROWS_PER_TASK = 2_000_000


class MissingParents(ValueError):
    """Child rows were asked for while the parent table is empty."""


class DuplicateKeys(ValueError):
    """A generated key already exists."""


def row_numbers(spark: SparkSession, n: int) -> DataFrame:
    """``i`` = 0..n-1, split so that no task builds more than ROWS_PER_TASK rows."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return spark.range(0, n, 1, max(1, min(tasks, max(n, 1)))).withColumnRenamed("id", "i")


def parent_index(keys: DataFrame, pk: str, rows: int) -> DataFrame:
    """Parent keys numbered 1..rows in the order of their digest."""
    tagged = keys.select(F.col(pk).cast("string").alias("_parent")).withColumn("_digest", F.md5("_parent"))
    return index_by_digest(tagged, "_digest", out="_parent_no", digits=digits_for(rows)).drop("_digest")


def assign_parents(children: DataFrame, parents: DataFrame, pk: str, out: str, h: Column) -> DataFrame:
    """Give each child a uniformly chosen parent key. The chosen numbers are uniform, so the
    join has no hot key; a small parent table is broadcast by Catalyst."""
    n = parents.count()
    if n == 0:
        raise MissingParents(f"missing_parent_rows: no rows for '{out}' to point at")
    numbered = children.withColumn("_want", h % F.lit(n) + 1)
    index = parent_index(parents, pk, n)
    joined = numbered.join(index, F.col("_want") == F.col("_parent_no"), "left")
    return joined.withColumn(out, F.col("_parent")).drop("_want", "_parent_no", "_parent")


def generate(spark: SparkSession, table: Table, n: int, seed, batch_ts: Column,
             parents: Mapping[str, tuple[DataFrame, str]] | None = None,
             numbers: DataFrame | None = None) -> DataFrame:
    """``n`` rows of a declared table plus their number ``i``; ``version`` is left NULL.

    ``parents`` maps a parent table to (its keys, the key column). ``numbers`` may bring
    the row numbers (and extra columns) instead of 0..n-1.
    """
    rows = numbers if numbers is not None else row_numbers(spark, n)
    carried = [c for c in rows.columns if c != "i"]
    for ref, parent in table.refs.items():
        if parent not in (parents or {}):
            raise MissingParents(f"missing_parent_rows: '{parent}' is not at hand for '{ref}'")
        keys, pk = parents[parent]
        rows = assign_parents(rows, keys, pk, f"_ref_{ref}", draw(seed, table.name, ref, F.col("i")))

    def value(f) -> Column:
        auto = f.metadata.get("auto")
        if auto in ("created", "updated"):
            return batch_ts
        if auto in ("soft_delete", "version"):
            return F.lit(None)
        if f.name in table.refs:
            return F.col(f"_ref_{f.name}")
        return field_value(f, seed, table.name, F.col("i"), batch_ts)

    return rows.select(
        "i", *carried, *[value(f).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def updated_values(table: Table, seed, batch_ts: Column) -> dict[str, Column]:
    """New values of everything an update rewrites, drawn by primary key so that they do not
    depend on which other rows are updated."""
    salt = f"{table.name}.update"
    new = {f.name: field_value(f, seed, salt, F.col(table.pk), batch_ts).cast(f.dataType)
           for f in table.mutable}
    return new | {name: batch_ts for name in table.autos("updated")}


def row_plan(tables: DataFrame, counts: DataFrame, count: int | None) -> DataFrame:
    """Rows to make per table: its own count, else the common one, else the declared one."""
    return tables.join(counts.withColumnRenamed("n", "_n"), "entity", "left").select(
        "entity",
        F.coalesce("_n", F.lit(count).cast("bigint"), "initial_count").cast("bigint").alias("n"))


def existing_keys(new: DataFrame, old: DataFrame, pk: str, n: int | None = None) -> DataFrame:
    """Generated keys that an existing row already holds.

    The table is scanned against the new keys, so that ``n`` of them, if that is few enough to
    broadcast, leave the table where it lies.
    """
    wanted = new.select(pk)
    if n is not None and fits_broadcast(old, n):
        wanted = F.broadcast(wanted)  # n keys
    return old.select(pk).join(wanted, pk, "left_semi")


def repeated_keys(rows: DataFrame, pk: str) -> DataFrame:
    return rows.groupBy(pk).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def new_keys(spark: SparkSession, table: Table, n: int, seed) -> DataFrame:
    """The keys ``generate`` will give, without building the rows."""
    key = field_value(table.schema[table.pk], seed, table.name, F.col("i"), F.lit(None))
    return row_numbers(spark, n).select(key.alias(table.pk))


def check_new_keys(new: DataFrame, old: DataFrame, pk: str, n: int | None = None) -> None:
    if not existing_keys(new, old, pk, n).isEmpty():
        raise DuplicateKeys("duplicate_primary_key: a generated key exists; take another seed")
    if not repeated_keys(new, pk).isEmpty():
        raise DuplicateKeys("duplicate_primary_key: two generated keys are equal; take another seed")


def seed_missing(spark: SparkSession, tables: Mapping[str, Table], data: Mapping[str, DataFrame],
                 seed, batch_ts: Column) -> dict[str, DataFrame]:
    """Fill the tables that are empty, parents first, and keep the others as they are."""
    out = dict(data)
    for name in load_order(dict(tables)):
        table = tables[name]
        if not out[name].isEmpty():
            continue
        keys = {p: (out[p], tables[p].pk) for p in table.parents}
        rows = generate(spark, table, table.initial_count, seed, batch_ts, keys)
        out[name] = rows.withColumn("version", F.col("i") + 1).drop("i")
    return out
