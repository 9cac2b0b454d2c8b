"""The change log as a feed: cursors, pages, enrichment, deltas and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ranking import chunked, index_by_integer
from tidemark.operators.skew import join_unique

OPS = ["insert", "update", "delete"]
LOG_COLUMNS = ["entity", "pk_value", "op", "version", "changed_at"]
STALE_CURSOR = "cursor_ahead_of_source"


class CursorAhead(ValueError):
    """The cursor lies beyond the newest version of the source."""

    def __init__(self, entity: str, since: int, latest: int):
        super().__init__(f"{STALE_CURSOR}: {entity} is at version {latest}, the cursor says {since}")
        self.since, self.latest = since, latest


# ------------------------------------------------------------------- versions
def latest_versions(log: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Newest version per entity; 0 for a listed entity that has no entry."""
    latest = log.groupBy("entity").agg(F.max("version").alias("latest_version"))
    if entities is None:
        return latest
    return entities.join(latest, "entity", "left").select(
        "entity", F.coalesce("latest_version", F.lit(0)).alias("latest_version"))


def next_versions(row_versions: DataFrame, log: DataFrame) -> DataFrame:
    """Next free version per entity: one above everything the rows or the log ever used."""
    in_rows = row_versions.groupBy("entity").agg(F.max("version").alias("_rows"))
    in_log = log.groupBy("entity").agg(F.max("version").alias("_log"))
    zero = F.lit(0)
    return in_rows.join(in_log, "entity", "full").select(
        "entity",
        (F.greatest(F.coalesce("_rows", zero), F.coalesce("_log", zero)) + 1).alias("next_version"))


def entity_latest(log: DataFrame, entity: str) -> int:
    """Newest version of one entity as a number, 0 if none."""
    return log.filter(F.col("entity") == entity).agg(F.max("version")).first()[0] or 0


def entity_next(table: DataFrame, log: DataFrame, entity: str) -> int:
    in_rows = table.agg(F.max("version")).first()[0] or 0
    return max(in_rows, entity_latest(log, entity)) + 1


# ----------------------------------------------------------------------- pages
def between(log: DataFrame, entity: str, since: Column | int, upto: Column | int | None = None) -> DataFrame:
    """Entries with since < version <= upto. On a log partitioned by entity this prunes to one
    partition and skips row groups by their version range."""
    rows = log.filter((F.col("entity") == entity) & (F.col("version") > since))
    return rows if upto is None else rows.filter(F.col("version") <= upto)


def feed_page(log: DataFrame, entity: str, since: int, limit: int = 100) -> DataFrame:
    return between(log, entity, since).orderBy("version").limit(limit)


def page_facts(log: DataFrame, entity: str, since: int, limit: int = 100) -> DataFrame:
    """next_cursor, latest_version and has_more of one page. A full page says there is more."""
    page = feed_page(log, entity, since, limit).agg(
        F.coalesce(F.max("version"), F.lit(since)).cast("bigint").alias("next_cursor"),
        (F.count(F.lit(1)) == limit).alias("has_more"),
    ).withColumn("entity", F.lit(entity))
    return page.join(latest_versions(log.filter(F.col("entity") == entity)), "entity", "left").select(
        "entity", "next_cursor",
        F.coalesce("latest_version", F.lit(0)).alias("latest_version"), "has_more")


def enrich(changes: DataFrame, current: DataFrame, pk: str) -> DataFrame:
    """Each change with the current values of its row; op and version are the change's own.
    A row that is gone leaves only its key."""
    values = [c for c in current.columns if c not in (pk, "version", "op")]
    rows = current.select(F.col(pk).cast("string").alias("_pk"), *values)
    return join_unique(changes.select("pk_value", "op", "version"), rows, "pk_value", "_pk").select(
        "op", F.col("pk_value").alias(pk), *values, "version")


def delta(log: DataFrame, current: DataFrame, entity: str, pk: str, since, upto) -> DataFrame:
    return enrich(between(log, entity, since, upto), current, pk)


def read_changes(log: DataFrame, current: DataFrame, entity: str, pk: str, since: int,
                 limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """One poll: the enriched page and its cursor facts. Raises on a stale cursor."""
    latest = entity_latest(log, entity)
    if since > latest:
        raise CursorAhead(entity, since, latest)
    page = enrich(feed_page(log, entity, since, limit), current, pk)
    return page, page_facts(log, entity, since, limit)


def drain(log: DataFrame, limit: int) -> DataFrame:
    """Every page a poller would see from cursor 0, for all entities at once."""
    indexed = index_by_integer(log.select("entity", "version"), "version", by=["entity"])
    return chunked(indexed, limit, out="page").groupBy("entity", "page").agg(
        F.min("version").alias("first_version"),
        F.max("version").alias("next_cursor"),
        F.count(F.lit(1)).alias("n_changes"),
        (F.count(F.lit(1)) == limit).alias("has_more"))


def cursor_status(cursors: DataFrame, log: DataFrame) -> DataFrame:
    """Every consumer cursor (entity, since) with its lag, or the stale-cursor code."""
    latest = F.coalesce("latest_version", F.lit(0))
    ahead = F.col("since") > latest
    newest = latest_versions(log).withColumnRenamed("entity", "_entity")
    return join_unique(cursors, newest, "entity", "_entity").select(
        *cursors.columns, latest.alias("latest_version"),
        F.when(ahead, STALE_CURSOR).otherwise("ok").alias("status"),
        F.when(~ahead, latest - F.col("since")).alias("lag"))


# ---------------------------------------------------------------------- replay
def op_code(op: Column) -> Column:
    """Position of the op in OPS, counted from 1."""
    return F.array_position(F.array(*[F.lit(o) for o in OPS]), op)


def op_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in OPS]), code.cast("int"))


def last_change(changes: DataFrame, *keys: str) -> DataFrame:
    """Last version and op per key.

    Version and op travel as one bigint, so this is a plain max: hash-aggregated and
    combined map-side, whatever share of the log one key holds.
    """
    packed = F.max(F.col("version") * 4 + op_code(F.col("op"))).alias("_last")
    return changes.groupBy(*keys).agg(packed).select(
        *keys, F.shiftright("_last", 2).alias("version"), op_name(F.col("_last") % 4).alias("op"))


def replay(snapshot: DataFrame, changes: DataFrame, pk: str) -> DataFrame:
    """The table after applying enriched ``changes`` to a snapshot. Idempotent: only the last
    change of a key counts, and only if it is newer than the snapshot's row, so overlapping,
    repeated or older input gives the same table."""
    values = [c for c in snapshot.columns if c not in (pk, "version")]
    last = last_change(changes, pk).select(pk, "version")
    # the join leaves rows placed by (key, version), so dropping repeats there is free
    newest = changes.join(last, [pk, "version"], "left_semi").dropDuplicates([pk, "version"])
    theirs = newest.select(
        F.col(pk).alias("_pk"), F.col("version").alias("_version"), F.col("op").alias("_op"),
        *[F.col(c).alias(f"_new_{c}") for c in values])
    newer = F.col("_op").isNotNull() & F.coalesce(F.col("_version") > F.col("version"), F.lit(True))
    return (
        snapshot.join(theirs, F.col(pk) == F.col("_pk"), "full")
        .filter(~(newer & (F.col("_op") == "delete")))
        .select(
            F.coalesce(pk, "_pk").alias(pk),
            *[F.when(newer, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
            F.when(newer, F.col("_version")).otherwise(F.col("version")).alias("version"))
    )
