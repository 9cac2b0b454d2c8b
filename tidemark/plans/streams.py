"""Structured Streaming queries (S): run to the end of a file log, result read from the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import LOG, Roles, query
from tidemark.session import scratch_path
from tidemark.streaming import feeds

_CUSTOMER_LOG = f"{LOG}, clog AS (SELECT * FROM chg WHERE entity = 'customers')"


RUNS = 4


def _log_of(events):
    """Events as log entries."""
    op = (F.when(F.col("event_type") == "signup", "insert")
          .when(F.col("event_type") == "error", "delete").otherwise("update"))
    return events.select(
        F.lit("customers").alias("entity"), F.col("user_id").cast("string").alias("pk_value"), op.alias("op"),
        (F.col("event_id") + 1).alias("version"), F.col("ts").alias("changed_at"))


def _consumed(t: Roles, made, label: str, run=feeds.run_to_end):
    """The events arrive in RUNS parts in time order; after each the stream ``made`` of them goes on from its
    checkpoint, so state lives across triggers and restarts. A last run finds nothing new."""
    folder, out, cursor = (scratch_path(t.spark, f"{label}-{x}") for x in ("events", "out", "cursor"))
    events, us = t.tab("events"), F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(us.alias("us")).approxQuantile("us", [k / RUNS for k in range(1, RUNS)], 0.01)
    part = sum((F.when(us > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    stream = None
    for k in range(RUNS):
        events.where(part == k).write.mode("append").parquet(folder)
        if stream is None:
            stream = made(feeds.follow(t.spark, folder, events.schema))
        run(stream, out, cursor)
    run(stream, out, cursor)
    return feeds.read_sink(t.spark, out, stream)


@query("s1_consumed_feed", f"WITH {_CUSTOMER_LOG} SELECT * FROM clog")
def _(t):
    return _consumed(t, _log_of, "feed")


@query("s2_current_states", f"""
WITH {_CUSTOMER_LOG} SELECT entity, pk_value, max(version) AS version, arg_max(op, version) AS op FROM clog GROUP BY 1, 2""")
def _(t):
    emitted = _consumed(t, lambda events: feeds.key_states(_log_of(events)), "states", run=feeds.update_to_end)
    return feeds.current_states(emitted)


@query("s3_deduplicated", f"WITH {_CUSTOMER_LOG} SELECT * FROM clog")
def _(t):
    """Every entry delivered twice; state reaches back a day of event time."""
    return _consumed(t, lambda events: feeds.deduplicated(_log_of(events).union(_log_of(events))), "dedup")


@query("s3_deduplicated_within", f"WITH {_CUSTOMER_LOG} SELECT * FROM clog")
def _(t):
    return _consumed(t, lambda events: feeds.deduplicated(_log_of(events).union(_log_of(events)), "2 hours"), "dedup")


def _intervals(width: str, closed_only: bool) -> str:
    having = (f"HAVING min(b) + INTERVAL {width} <= (SELECT date_trunc('milliseconds', max(changed_at)) - INTERVAL 1 HOUR FROM clog)"
              if closed_only else "")
    return f"""
WITH {_CUSTOMER_LOG}, binned AS (SELECT *, time_bucket(INTERVAL {width}, changed_at, TIMESTAMP '1970-01-01') AS b FROM clog)
SELECT entity, b AS interval_start, b + INTERVAL {width} AS interval_end, count(*) AS n_changes,
       count(*) FILTER (op = 'insert') AS inserted, count(*) FILTER (op = 'update') AS updated,
       count(*) FILTER (op = 'delete') AS deleted FROM binned GROUP BY entity, b {having}"""


@query("s4_interval_counts", _intervals("1 HOUR", True))
def _(t):
    """As a stream: intervals the watermark has closed."""
    return _consumed(t, lambda events: feeds.interval_counts(_log_of(events), "hourly"), "intervals")


@query("s4_daily_counts", _intervals("1 DAY", False))
def _(t):
    """The same definition over the whole log as a batch."""
    return feeds.interval_counts(t.customers_log, "daily", delay=None)


@query("s4_weekly_counts", _intervals("7 DAY", False))
def _(t):
    return feeds.interval_counts(t.customers_log, "weekly", delay=None)


@query("t6_throttled_uses_stream", """
WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL
  SELECT k.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.ts > k.ts + INTERVAL 360 MINUTE)
  FROM kept k WHERE k.ts IS NOT NULL)
SELECT user_id, ts FROM kept WHERE ts IS NOT NULL""")
def _(t):
    return _consumed(t, lambda events: feeds.refreshed_uses(events, "user_id", "ts", minutes=360), "uses")
