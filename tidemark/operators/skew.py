"""Joins of a possibly skewed fact side to a side that is unique on the join key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 1024        # at most this many keys are treated apart
SKETCH_SIZE = 16_384   # counters in the heavy-hitter sketch
KEY_BYTES = 256        # a row of a key and a few numbers, at most, in a broadcast


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.rstrip("bkmg")
    unit = text[len(digits):len(digits) + 1]
    return int(digits) * units.get(unit, 1)


def fits_broadcast(df: DataFrame, rows: int, more: int = 0) -> bool:
    """Do ``rows`` rows of a key and a few numbers, and ``more`` bytes of other values, stay under the session's
    broadcast threshold?"""
    return rows * KEY_BYTES + more <= broadcast_limit(df)


def hot_share(df: DataFrame) -> float:
    """The share of the rows that fills a shuffle partition by itself."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1 / max(parts, 2), 1 / HOT_KEYS)


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys with more rows than one shuffle partition should hold: one scan of the key column into
    fixed-size sketches, no shuffle of the rows. Only the plan depends on it, never the result."""
    found = df.agg(
        F.count(key).alias("n"),
        F.call_function("approx_top_k", F.col(key), F.lit(HOT_KEYS), F.lit(SKETCH_SIZE)).alias("top"),
    ).first()
    least = max(2.0, found["n"] * hot_share(df))
    # the sketch may list NULL; as an IN-list value it would make the negated filter drop rows
    return [item["item"] for item in found["top"]
            if item["item"] is not None and item["count"] >= least]


def join_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                how: str = "left", right_rows: int | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which holds each ``right_key`` at most once.

    A right side under Spark's broadcast threshold is left to Catalyst, which then
    broadcasts it and shuffles nothing; Catalyst overrates a right side that is itself a join, so
    a caller that knows a bound of its rows says so (``right_rows``). Beyond it, rows of hot left keys meet their right
    rows by a broadcast of at most ``HOT_KEYS`` rows and stay where they are; the others
    are joined by shuffle.
    """
    condition = F.col(left_key) == F.col(right_key)
    if broadcast_limit(left) >= 0 and plan_bytes(right) <= broadcast_limit(left):
        return left.join(right, condition, how)
    if right_rows is not None and fits_broadcast(left, right_rows):
        return left.join(F.broadcast(right), condition, how)  # a known number of rows
    hot = hot_keys(left, left_key)
    if not hot:
        return left.join(right, condition, how)
    in_hot = F.col(left_key).isin(hot)
    apart = left.filter(in_hot).join(
        F.broadcast(right.filter(F.col(right_key).isin(hot))), condition, how)
    rest = left.filter(~in_hot | F.col(left_key).isNull()).join(
        right.filter(~F.col(right_key).isin(hot)), condition, how)
    return apart.unionByName(rest)
