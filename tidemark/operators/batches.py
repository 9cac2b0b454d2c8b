"""Bulk writes: append, replace, reset, change batches and ticks.

Nothing here writes. Each operator returns the new table and the log entries it adds; the
caller writes both to fresh paths and publishes them together, which makes a batch all or
nothing: every guard fires before anything is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.draws import draw, percent_of
from tidemark.operators.feed import LOG_COLUMNS, entity_latest, entity_next
from tidemark.operators.generate import check_new_keys, generate, new_keys, updated_values
from tidemark.operators.ranking import digits_for, index_by_digest, split_sample
from tidemark.operators.rows import live, live_keys
from tidemark.operators.skew import fits_broadcast
from tidemark.operators.summaries import live_and_total
from tidemark.schema import Table, load_order, with_dependents
from tidemark.session import pin

@dataclass(frozen=True)
class Mutation:
    """What a write makes of a table: its new rows, the log entries to append, and counts."""

    rows: DataFrame
    log: DataFrame
    stats: dict
    notes: list[str] = field(default_factory=list)


def log_rows(rows: DataFrame, entity: str, key: Column, op: Column | str, at: Column) -> DataFrame:
    """Log entries for rows that carry the version of their change."""
    return rows.select(
        F.lit(entity).alias("entity"), key.cast("string").alias("pk_value"),
        (F.lit(op) if isinstance(op, str) else op).alias("op"),
        F.col("version").cast("bigint").alias("version"), at.alias("changed_at"))


def _check_counts(values: list[int], row_limit: int | None) -> None:
    if any(v < 0 or (row_limit is not None and v > row_limit) for v in values):
        raise ValueError(f"invalid_count: row counts lie within 0-{row_limit}")


def _no_log(log: DataFrame) -> DataFrame:
    return log.select(LOG_COLUMNS).limit(0)


# ------------------------------------------------------------------- appending
def insert_rows(spark: SparkSession, table: Table, n: int, seed, batch_ts: Column, first_version: int,
                parents=None) -> DataFrame:
    """``n`` generated rows with contiguous versions: the row number is the offset, so no
    ranking and no shuffle."""
    rows = generate(spark, table, n, seed, batch_ts, parents)
    return rows.withColumn("version", F.col("i") + F.lit(first_version)).select(table.columns)


def append(spark: SparkSession, table: Table, rows: DataFrame, log: DataFrame, n: int, seed,
           batch_ts: Column, parents=None, check: bool = True) -> Mutation:
    first = entity_next(rows, log, table.name)
    new = insert_rows(spark, table, n, seed, batch_ts, first, parents)
    if check:
        check_new_keys(new_keys(spark, table, n, seed), rows, table.pk, n)
    stats = {"entity": table.name, "inserted": n,
             "first_version": first if n else None, "last_version": first + n - 1 if n else None}
    return Mutation(rows.select(table.columns).unionByName(new),
                    log_rows(new, table.name, F.col(table.pk), "insert", batch_ts), stats)


def tombstones(table: Table, rows: DataFrame, first_version: int, batch_ts: Column, n: int) -> DataFrame:
    """One delete entry per row, soft-deleted ones too, numbered in key-digest order."""
    keyed = rows.select(F.col(table.pk).cast("string").alias("_key"))
    numbered = index_by_digest(
        keyed.withColumn("_digest", F.md5("_key")), "_digest", digits=digits_for(n))
    return log_rows(numbered.withColumn("version", F.col("idx") + F.lit(first_version - 1)),
                    table.name, F.col("_key"), "delete", batch_ts)


def replace(spark: SparkSession, table: Table, rows: DataFrame, log: DataFrame, n: int, seed,
            batch_ts: Column, parents=None) -> Mutation:
    """Old rows become delete entries, new rows go on top; versions keep climbing."""
    first = entity_next(rows, log, table.name)
    wiped = rows.count()
    new = insert_rows(spark, table, n, seed, batch_ts, first + wiped, parents)
    entries = tombstones(table, rows, first, batch_ts, wiped).unionByName(
        log_rows(new, table.name, F.col(table.pk), "insert", batch_ts))
    return Mutation(new, entries, {
        "entity": table.name, "deleted": wiped, "inserted": n,
        "first_version": first + wiped if n else None,
        "last_version": first + wiped + n - 1 if n else None})


def forget(history: DataFrame, entities: list[str]) -> DataFrame:
    """The log (or run history) without the entries of the given tables."""
    return history.filter(~F.col("entity").isin(entities))


def reset(spark: SparkSession, table: Table, n: int, seed, batch_ts: Column, parents=None) -> Mutation:
    """Start over at version 1; the caller drops the old history with ``forget``."""
    new = insert_rows(spark, table, n, seed, batch_ts, 1, parents)
    return Mutation(new, log_rows(new, table.name, F.col(table.pk), "insert", batch_ts), {
        "entity": table.name, "inserted": n,
        "first_version": 1 if n else None, "last_version": n if n else None})


def _refuse_if(*rules: tuple[object, str]) -> None:
    """Raise the code of the first rule whose condition holds."""
    for holds, code in rules:
        if holds:
            raise ValueError(code)


def _within_cap(table: Table, rows: DataFrame, added: int, keeps: bool) -> None:
    """A declared cap refuses a write that would leave more rows than it."""
    if table.max_rows is None or not added:
        return
    after = added + (rows.count() if keeps else 0)
    _refuse_if((after > table.max_rows, f"quota_exceeded: {table.name} would hold {after} rows, its cap is {table.max_rows}"))


def run_batch(spark: SparkSession, tables: Mapping[str, Table], data: Mapping[str, DataFrame],
              log: DataFrame, batch_ts: Column, mode: str = "append", entities: list[str] | None = None,
              counts: Mapping[str, int] | None = None, count: int | None = None, seed=0,
              confirm: bool = False, row_limit: int | None = None) -> tuple[dict[str, DataFrame], DataFrame, list[dict]]:
    """Append to, replace or reset the named tables, parents first.

    Returns the new tables, the new whole log, and the counts per table. Replace and
    reset take every dependent table along; a reset also ends the run history of the tables in
    the counts, see ``forget``. Declared row caps are checked before any row is made.
    """
    counts = dict(counts or {})
    named = list(entities or counts or tables)
    strangers = sorted({*named, *counts} - set(tables))
    order = load_order(dict(tables))
    wide = named if mode == "append" else with_dependents(dict(tables), [n for n in named if n in tables])
    targets = [t for t in order if t in set(wide)]
    unused = sorted(set(counts) - set(targets))
    _refuse_if((mode not in ("append", "replace", "reset"), f"invalid_mode: {mode}"),
               (strangers, f"unknown_entity: {strangers}"))
    _check_counts([*counts.values(), *([] if count is None else [count])], row_limit)
    _refuse_if((unused, f"counts_not_targeted: {unused}"),
               (mode != "append" and not confirm, f"confirmation_required: '{mode}' deletes rows"))
    for name in targets:
        planned = counts.get(name, tables[name].initial_count if count is None else count)
        _within_cap(tables[name], data[name], planned, keeps=mode == "append")

    out, entries, stats = dict(data), [], []
    history = forget(log, targets) if mode == "reset" else log
    needed = {p for t in targets for p in tables[t].parents}
    keys = {p: data[p].select(tables[p].pk) for p in needed}
    for name in targets:
        table = tables[name]
        n = counts.get(name, table.initial_count if count is None else count)
        parents = {p: (keys[p], tables[p].pk) for p in table.parents}
        if n == 0:
            made = _empty_batch(table, mode, out[name], log, batch_ts)
        elif mode == "append":
            made = append(spark, table, out[name], log, n, seed, batch_ts, parents)
        elif mode == "replace":
            made = replace(spark, table, out[name], log, n, seed, batch_ts, parents)
        else:
            made = reset(spark, table, n, seed, batch_ts, parents)
        out[name] = made.rows
        if name in needed:  # stored once, so that children do not redo the parent's batch
            keys[name] = pin(made.rows.select(table.pk), f"keys-{name}")
        entries.append(made.log)
        stats.append(made.stats)
    whole = history.select(LOG_COLUMNS)
    for part in entries:
        whole = whole.unionByName(part)
    return out, whole, stats


def _empty_batch(table: Table, mode: str, rows: DataFrame, log: DataFrame, batch_ts: Column) -> Mutation:
    stats = {"entity": table.name, "inserted": 0, "first_version": None, "last_version": None}
    if mode == "append":
        return Mutation(rows.select(table.columns), _no_log(log), stats)
    if mode == "reset":
        return Mutation(rows.select(table.columns).limit(0), _no_log(log), stats)
    wiped = rows.count()
    first = entity_next(rows, log, table.name)
    return Mutation(rows.select(table.columns).limit(0),
                    tombstones(table, rows, first, batch_ts, wiped), stats | {"deleted": wiped})


# -------------------------------------------------------------- change batches
def tick_sizes(counts: DataFrame, table: Table, seed, inserts: int | None = None,
               updates: int | None = None, deletes: int | None = None) -> DataFrame:
    """Asked and applied sizes of a change batch from a (live_rows, total_rows) row.

    What the caller leaves out is one tick's worth. Updates are clamped to the live rows,
    deletes to the live rows not updated, and each clamp leaves a note.
    """
    low, high = table.new_records
    live_rows = F.col("live_rows")

    def given(value, default):
        return F.lit(value).cast("bigint") if value is not None else default

    default_inserts = F.lit(low) + draw(seed, table.name, "tick", F.lit(0)) % F.lit(high - low + 1)
    sized = counts.withColumn("inserts", given(inserts, default_inserts).cast("bigint"))
    sized = sized.withColumn("updates_asked", given(updates, percent_of(live_rows, table.mutate_pct)))
    sized = sized.withColumn("updates", F.least("updates_asked", live_rows))
    left = live_rows - F.col("updates")
    share = table.delete_pct if table.soft_delete else 0
    sized = sized.withColumn("deletes_asked", given(deletes, percent_of(left, share)))
    sized = sized.withColumn("deletes", F.least(F.col("deletes_asked"), left))

    def note(what):
        text = F.format_string(
            f"{table.name}: asked to {what} %d rows, did %d",
            F.col(f"{what}s_asked"), F.col(f"{what}s"))
        return F.when(F.col(f"{what}s_asked") > F.col(f"{what}s"), text)

    return sized.withColumn("update_note", note("update")).withColumn("delete_note", note("delete"))


def headroom(counts: DataFrame, max_rows: int | None, asked: Column) -> DataFrame:
    """Inserts a cap leaves room for: a tick is cut to ``allowed``, an explicit request with
    ``over_cap`` fails."""
    if max_rows is None:
        return counts.withColumn("allowed", asked).withColumn("over_cap", F.lit(False))
    room = F.greatest(F.lit(0), F.lit(max_rows) - F.col("total_rows"))
    return counts.withColumn("allowed", F.least(asked, room).cast("bigint")).withColumn(
        "over_cap", asked > room)


def change_batch(spark: SparkSession, table: Table, rows: DataFrame, log: DataFrame, seed,
                 batch_ts: Column, parents=None, inserts: int | None = None,
                 updates: int | None = None, deletes: int | None = None,
                 cap: int | None = None, check: bool = True) -> Mutation:
    """Inserts, updates and soft-deletes in one batch.

    Updated and deleted rows are drawn from the rows live before the batch and are
    disjoint. Versions run inserts, updates, deletes. One sample, one join of it onto the
    table, one union.
    """
    if deletes and not table.soft_delete:
        raise ValueError(f"not_supported: '{table.name}' has no soft-delete field")
    # one scan: live and total rows, and the highest version
    plan = tick_sizes(live_and_total(rows, table.soft_delete, F.max("version").alias("top")), table, seed, inserts, updates, deletes)
    if cap is not None:
        plan = headroom(plan, cap, F.col("inserts"))
        if inserts is None:
            plan = plan.withColumn("inserts", F.col("allowed"))
    sizes = plan.first()  # one row of counts
    if cap is not None and inserts is not None and sizes["over_cap"]:
        raise ValueError(f"quota_exceeded: {inserts} more rows would exceed the cap of {cap} of '{table.name}'")
    n_ins, n_upd, n_del = sizes["inserts"], sizes["updates"], sizes["deletes"]
    first = max(sizes["top"] or 0, entity_latest(log, table.name)) + 1
    base = first - 1 + n_ins

    picked = split_sample(
        live_keys(rows, table.pk, table.soft_delete), table.pk, seed, n_upd, n_del,
        digits=digits_for(sizes["live_rows"])
    ).select(F.col(table.pk).alias("_pk"), "action", (F.col("idx") + F.lit(base)).alias("_version"))
    changed = updated_values(table, seed, batch_ts)
    is_update, is_delete = F.col("action") == "update", F.col("action") == "delete"

    def merged(name: str) -> Column:
        if name == "version":
            return F.coalesce("_version", "version")
        if name in changed:
            return F.when(is_update, changed[name]).otherwise(F.col(name))
        if name == table.soft_delete:
            return F.when(is_delete, batch_ts).otherwise(F.col(name))
        return F.col(name)

    # few changes meet the rows where they lie; the table is shuffled only for many
    beside = F.broadcast(picked) if fits_broadcast(rows, n_upd + n_del) else picked
    after = rows.join(beside, F.col(table.pk) == F.col("_pk"), "left").select(
        *[merged(c).alias(c) for c in table.columns])
    entries = log_rows(picked.withColumnRenamed("_version", "version"),
                       table.name, F.col("_pk"), F.col("action"), batch_ts)
    if n_ins:
        new = insert_rows(spark, table, n_ins, seed, batch_ts, first, parents)
        if check:
            check_new_keys(new_keys(spark, table, n_ins, seed), rows, table.pk, n_ins)
        after = after.unionByName(new)
        entries = log_rows(new, table.name, F.col(table.pk), "insert", batch_ts).unionByName(entries)
    total = n_ins + n_upd + n_del
    stats = {
        "entity": table.name, "inserted": n_ins, "updated": n_upd, "deleted": n_del,
        "first_version": first if total else None, "last_version": first + total - 1 if total else None,
        "live_rows": sizes["live_rows"] + n_ins - n_del, "total_rows": sizes["total_rows"] + n_ins,
    }
    return Mutation(after, entries, stats, [n for n in (sizes["update_note"], sizes["delete_note"]) if n])


def run_changes(spark: SparkSession, tables: Mapping[str, Table], data: Mapping[str, DataFrame],
                log: DataFrame, batch_ts: Column, seed=0, entities: list[str] | None = None,
                inserts: int | None = None, updates: int | None = None, deletes: int | None = None,
                row_limit: int | None = None) -> tuple[dict[str, DataFrame], DataFrame, list[dict], list[str]]:
    """One change batch over several tables, parents first.

    New child rows point only at parents that are live by then: those inserted earlier in
    the request count, those deleted earlier do not. A changed parent's live keys are
    stored once, so children do not redo the parent's batch.
    """
    _check_counts([v for v in (inserts, updates, deletes) if v is not None], row_limit)
    strangers = sorted(set(entities or []) - set(tables))
    _refuse_if((strangers, f"unknown_entity: {strangers}"))
    targets = [t for t in load_order(dict(tables)) if not entities or t in entities]
    needed = {p for t in targets for p in tables[t].parents}
    out, live_now = dict(data), {}
    entries, stats, notes = [], [], []
    for name in load_order(dict(tables)):
        table = tables[name]
        if name in targets:
            parents = {p: (live_now[p], tables[p].pk) for p in table.parents}
            made = change_batch(spark, table, out[name], log, seed, batch_ts, parents,
                                inserts, updates, deletes, cap=table.max_rows)
            out[name] = made.rows
            entries.append(made.log)
            stats.append(made.stats)
            notes += made.notes
        if name in needed:
            keys = live(out[name], table.soft_delete).select(table.pk)
            live_now[name] = pin(keys, f"live-{name}") if name in targets else keys
    whole = log.select(LOG_COLUMNS)
    for part in entries:
        whole = whole.unionByName(part)
    return out, whole, stats, notes


def tick(spark: SparkSession, table: Table, rows: DataFrame, log: DataFrame, seed,
         batch_ts: Column, parents=None) -> Mutation:
    """One scheduled tick: a change batch of default sizes, inserts cut to the row cap,
    parents drawn from all rows (soft-deleted too)."""
    return change_batch(spark, table, rows, log, seed, batch_ts, parents, cap=table.max_rows)


def recorded(spark: SparkSession, runs: DataFrame, entity: str, at: Column, write: Callable[[], dict]) -> DataFrame:
    """Runs ``write``, which makes and stores a batch and returns its counts, and returns the record
    for the run history: written after the fact, ``failed`` whatever went wrong."""
    run_id = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
    try:
        stats = write()
    except Exception:  # the record says that the run failed; the caller logs why
        stats = None
    return run_record(spark, run_id, entity, at, stats)


def run_record(spark: SparkSession, run_id: int, entity: str, at: Column, stats: dict | None) -> DataFrame:
    """One row for the run history; no stats means the run failed."""
    done = stats or {}

    def n(name):
        return F.lit(done.get(name, 0)).cast("bigint")

    return spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(entity).alias("entity"),
        at.alias("started_at"), at.alias("finished_at"),
        n("inserted").alias("rows_inserted"), n("updated").alias("rows_mutated"),
        n("deleted").alias("rows_deleted"),
        F.lit("success" if stats is not None else "failed").alias("status"))
