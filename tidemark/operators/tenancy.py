"""Ownership, visibility, credentials and run reporting over the registry tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import key_hash, micros_of, wall_time
from tidemark.operators.skew import join_unique
from tidemark.operators.summaries import last_per_group, privacy_fold, row_counts

# Fixed value: a use is recorded only when the last recorded one is older than this.
REFRESH_MINUTES = 5


# ------------------------------------------------------------------ credentials
def active_credentials(keys: DataFrame, providers: DataFrame) -> DataFrame:
    """Keys that work: not revoked, provider active. Inner join of two unique sides."""
    owners = providers.filter("is_active").select(F.col("id").alias("_owner"), "full_name")
    good = keys.filter(F.col("revoked_at").isNull())
    return join_unique(good, owners, "provider_id", "_owner", "inner").select(
        F.col("id").alias("key_id"), "key_hash", "provider_id", "full_name")


def attribute(requests: DataFrame, secret: str, keys: DataFrame, providers: DataFrame) -> DataFrame:
    """Each request with the key and provider behind its secret; NULL when there is none."""
    known = active_credentials(keys, providers).withColumnRenamed("key_hash", "_hash")
    asked = requests.withColumn("_presented", key_hash(F.col(secret)))
    return join_unique(asked, known, "_presented", "_hash", right_rows=keys.count()).drop("_presented", "_hash")


def with_names(rows: DataFrame, fk: str, dim: DataFrame, pk: str, **columns: str) -> DataFrame:
    """Rows enriched with columns of the dimension row they point at."""
    chosen = dim.select(F.col(pk).alias("_pk"), *[F.col(src).alias(out) for out, src in columns.items()])
    return join_unique(rows, chosen, fk, "_pk").drop("_pk")


# ------------------------------------------------------------------- visibility
def with_privacy(configs: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``is_private``: the project's flag, true when the project is missing."""
    flags = projects.select(F.col("id").alias("_project"), F.col("is_only_me").alias("_flag"))
    return join_unique(configs, flags, "project_id", "_project").withColumn(
        "is_private", F.coalesce("_flag", F.lit(True))).drop("_project", "_flag")


def visible(things: DataFrame, principal: str | None, scope: str = "all", superuser: bool = False,
            system_owner: str = "prov_system", project_id: str | None = None) -> DataFrame:
    """What a principal may read, narrowed to mine / shared / all, in (name, id) order.
    ``things`` carry provider_id and is_private."""
    owner = F.col("provider_id")
    rows = things if project_id is None else things.filter(F.col("project_id") == project_id)
    if not superuser:
        rows = rows.filter((owner == principal) | ~F.col("is_private"))
    own = owner == (system_owner if superuser else principal)
    if scope == "mine":
        rows = rows.filter(own)
    elif scope == "shared":
        rows = rows.filter(~own)
    return rows.orderBy("name", "id")


def scope_counts(things: DataFrame, principals: DataFrame) -> DataFrame:
    """For every principal: how many things are theirs, shared with them, and both.

    Counted from per-owner totals; pairs of principals and things are never formed.
    """
    per_owner = things.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("_own"), F.count_if(~F.col("is_private")).alias("_public"))
    everyone = per_owner.agg(F.coalesce(F.sum("_public"), F.lit(0)).alias("_all_public")).withColumn("_k", F.lit(1))
    own, public = F.coalesce("_own", F.lit(0)), F.coalesce("_public", F.lit(0))
    return (
        principals.join(per_owner, F.col("id") == F.col("provider_id"), "left")
        .withColumn("_k", F.lit(1)).join(F.broadcast(everyone), "_k")  # one row
        .select("id", own.alias("mine"), (F.col("_all_public") - public).alias("shared"),
                (own + F.col("_all_public") - public).alias("visible"))
    )


def decide(requests: DataFrame, things: DataFrame, n_things: int | None = None) -> DataFrame:
    """ok / not_found / forbidden for every access request (thing_id, principal, superuser, need).
    ``n_things`` is a bound of the things, if the caller knows one."""
    known = things.select(
        F.col("id").alias("_id"), F.col("provider_id").alias("_owner"), F.col("is_private").alias("_private"))
    may_write = F.col("superuser") | (F.col("principal") == F.col("_owner"))
    may_read = may_write | ~F.col("_private")
    verdict = (
        F.when(F.col("_id").isNull() | ~may_read, "not_found")
        .when((F.col("need") == "write") & ~may_write, "forbidden").otherwise("ok"))
    return join_unique(requests, known, "thing_id", "_id", right_rows=n_things).withColumn("decision", verdict).drop(
        "_id", "_owner", "_private")


# --------------------------------------------------------------- name ownership
def get_or_create(requests: DataFrame, existing: DataFrame, on_exists: str = "error") -> DataFrame:
    """Settle a batch of wanted names (request_id, name_key) against existing (id, name_key).

    A free name goes to its lowest request; every other request for it reuses that row or
    is refused. Free names are settled by a map-side-combined minimum.
    """
    first = requests.groupBy("name_key").agg(F.min("request_id").alias("_first"))
    owners = first.join(
        existing.select(F.col("id").alias("_id"), F.col("name_key").alias("_known")),
        F.col("name_key") == F.col("_known"), "left",
    ).select(F.col("name_key").alias("_key"), "_first", "_id")
    clash = "reused" if on_exists == "reuse" else "already_exists"
    created = F.col("_id").isNull() & (F.col("request_id") == F.col("_first"))
    owner = F.coalesce("_id", F.concat(F.lit("new_"), F.col("_first").cast("string")))
    return join_unique(requests, owners, "name_key", "_key").select(
        "request_id", "name_key", F.when(created, "created").otherwise(clash).alias("outcome"),
        owner.alias("owner_id"))


def file_into_groups(configs: DataFrame, existing: DataFrame | None = None, system_group: str = "prj_system_examples",
                     group_name: str = "default") -> tuple[DataFrame, DataFrame]:
    """File ungrouped configs into one group per owner, private if any member was.

    An owner's ``existing`` group (id, provider_id) is used again, the lowest id of several. The id of a
    new one is a digest of the owner, so a second run gives the same ids. Configs of source yaml
    go to the system group.
    """
    yaml = F.col("source") == "yaml"
    group_id = F.concat(F.lit("prj_"), F.md5(F.concat_ws("|", F.lit(group_name), "provider_id")))
    filed = configs
    if existing is not None:
        had = existing.groupBy(F.col("provider_id").alias("_owner")).agg(F.min("id").alias("_had"))
        filed = join_unique(configs, had, "provider_id", "_owner").drop("_owner")
        group_id = F.coalesce("_had", group_id)
    filed = filed.withColumn("project_id", F.when(yaml, system_group).otherwise(group_id)).drop("_had")
    groups = privacy_fold(filed, "project_id", F.col("is_only_me")).select(
        F.col("project_id").alias("id"), F.col("is_private").alias("is_only_me"), "is_mixed", "n_members")
    return groups, filed.drop("is_only_me")


# --------------------------------------------------------------------- throttle
def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no (key, segment) group is cut in two."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        cut = int(np.flatnonzero(_group_starts(batch))[-1])
        last = held[-1].iloc[-1] if held else None
        first = batch.iloc[0]
        if cut == 0 and held and (last["key"], last["segment"]) == (first["key"], first["segment"]):
            held.append(batch)
            continue
        whole = held + ([batch.iloc[:cut]] if cut else [])
        if whole:
            yield pd.concat(whole, ignore_index=True)
        held = [batch.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_starts(pdf: pd.DataFrame) -> np.ndarray:
    keys, segments = pdf["key"].to_numpy(), pdf["segment"].to_numpy()
    starts = np.ones(len(pdf), dtype=bool)
    starts[1:] = (keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])
    return starts


def throttled_uses(uses: DataFrame, key: str, at: str, minutes: int = REFRESH_MINUTES,
                   segment_minutes: int = 60) -> DataFrame:
    """The uses that refresh a key's last-used time: the first, then each first use more than
    ``minutes`` after the last kept one.

    The rule is sequential per key, so each key's time line is cut into segments. A segment
    is reduced to a step function (last kept time before it -> last kept time after it); the
    short list of steps is walked per key; then all segments pick their kept uses at once.
    A task holds one segment of a key at a time, and a key's walk sees a few rows a segment.
    """
    gap, span = minutes * 60_000_000, segment_minutes * 60_000_000
    width = 2 * (span + gap)
    timed = uses.select(F.col(key).alias("key"), micros_of(F.col(at)).alias("us")).filter(
        "key IS NOT NULL AND us IS NOT NULL").withColumn(
        "segment", F.floor(F.col("us") / span).cast("bigint"))
    key_type = timed.schema["key"].dataType.simpleString()

    def chains(pdf: pd.DataFrame):
        """Group number, start of group, a line on which groups never meet, and each use's
        next kept use (itself if there is none in its segment)."""
        starts = _group_starts(pdf)
        group = np.cumsum(starts) - 1
        line = group * width + (pdf["us"].to_numpy() - pdf["segment"].to_numpy() * span)
        ahead = np.searchsorted(line, line + gap, "right")
        ends = np.append(np.flatnonzero(starts)[1:], len(pdf))[group]
        return starts, group, line, np.where(ahead < ends, ahead, np.arange(len(pdf)))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            starts, group, line, ahead = chains(pdf)
            last = ahead
            while (last != last[last]).any():
                last = last[last]
            us = pdf["us"].to_numpy()
            exits = us[last]
            # a use can be the first kept one only if the use before it lies within the gap
            entry = starts.copy()
            entry[1:] |= ~starts[1:] & (line[:-1] - group[:-1] * width < gap)
            same_next = np.zeros(len(pdf), dtype=bool)
            same_next[:-1] = entry[1:] & ~starts[1:] & (exits[1:] == exits[:-1])
            keep = entry & ~same_next
            yield pd.DataFrame({"key": pdf["key"][keep], "segment": pdf["segment"][keep],
                                "upper": us[keep] - gap, "exit": exits[keep]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, before, last, settled = (None, None), None, None, True
        for pdf in batches:
            entered = []
            for k, segment, upper, exit_ in zip(pdf["key"], pdf["segment"], pdf["upper"], pdf["exit"]):
                if (k, segment) != here:
                    before = last if k == here[0] else None
                    here, last, settled = (k, segment), before, False
                    entered.append((k, segment, before))
                if not settled and (before is None or upper > before):
                    last, settled = exit_, True
            out = pd.DataFrame(entered, columns=["key", "segment", "before"])
            yield out.astype({"before": "Int64"})

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            is_use = pdf["is_use"].to_numpy()
            since = pdf.loc[~is_use, "before"].to_numpy(dtype="float64", na_value=np.nan)
            pdf = pdf[is_use].reset_index(drop=True)
            starts, group, line, ahead = chains(pdf)
            firsts = np.flatnonzero(starts)
            entry = pdf["segment"].to_numpy()[firsts] * span
            waits = np.where(np.isnan(since), -1, np.maximum(np.nan_to_num(since) + gap - entry, -1))
            at_ = np.searchsorted(line, np.arange(len(firsts)) * width + waits.astype("int64"), "right")
            at_ = at_[at_ < np.append(firsts[1:], len(pdf))]
            kept = np.zeros(len(pdf), dtype=bool)
            while len(at_):
                kept[at_] = True
                following = ahead[at_]
                at_ = following[following != at_]
            yield pdf.loc[kept, ["key", "us"]]

    placed = timed.repartition("key", "segment").sortWithinPartitions("key", "segment", "us")
    stepped = placed.mapInPandas(steps, f"key {key_type}, segment bigint, upper bigint, exit bigint")
    entered = stepped.repartition("key").sortWithinPartitions("key", "segment", "upper").mapInPandas(
        walk, f"key {key_type}, segment bigint, before bigint")
    # the entry time of a segment travels as its first row: one shuffle of the uses, no join
    entries = entered.select("key", "segment", F.lit(0).cast("bigint").alias("us"), "before", F.lit(False).alias("is_use"))
    both = timed.select(
        "key", "segment", "us", F.lit(None).cast("bigint").alias("before"), F.lit(True).alias("is_use")
    ).unionByName(entries).repartition("key", "segment").sortWithinPartitions("key", "segment", "is_use", "us")
    return both.mapInPandas(pick, f"key {key_type}, us bigint").select(
        F.col("key").alias(key), wall_time(F.col("us")).alias(at))


# -------------------------------------------------------------------- reporting
def last_runs(entities: DataFrame, runs: DataFrame) -> DataFrame:
    """Last run of every entity by run id; NULL if it never ran. The status is carried as a
    flag so that the aggregate stays hash-based."""
    flagged = runs.withColumn("_ok", F.col("status") == "success")
    last = last_per_group(flagged, "entity", "run_id", last_run="finished_at", _last_ok="_ok")
    return entities.join(last, "entity", "left").withColumn(
        "last_status",
        F.when(F.col("_last_ok"), "success").when(~F.col("_last_ok"), "failed")).drop("_last_ok")


def metrics(entities: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows, last run, last status and cap per entity (entity, max_rows)."""
    report = last_runs(entities, runs).join(row_counts(rows, "entity"), "entity", "left")
    return report.withColumn("row_count", F.coalesce("row_count", F.lit(0)))
