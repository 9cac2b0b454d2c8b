"""Seeded values as pure functions of (seed, table, field, row).

No draw depends on partitioning, row order or task attempt, so a rerun, a retry or a
different cluster size gives the same table. Everything stays in built-in functions.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructField

# Default numeric domain and length of random text.
DEFAULT_LOW, DEFAULT_HIGH = 0, 1000
TEXT_LENGTH = 8

# Value pools behind the labels.
FIRST_NAMES = [
    "Ada", "Bruno", "Carla", "Dario", "Elena", "Felix", "Greta", "Hugo", "Ines", "Jonas",
    "Katia", "Leon", "Marta", "Nils", "Olga", "Pablo", "Quinn", "Rosa", "Sven", "Tara",
]
LAST_NAMES = [
    "Abbott", "Berger", "Costa", "Duarte", "Engel", "Ferrari", "Gomes", "Hansen", "Ito",
    "Jensen", "Kowalski", "Lopez", "Moreau", "Novak", "Okafor", "Petrov", "Quist", "Rossi",
    "Silva", "Tanaka",
]
JOB_TITLES = [
    "Account Manager", "Analyst", "Architect", "Clerk", "Consultant", "Designer", "Engineer",
    "Support Agent", "Supervisor", "Team Lead",
]
MAIL_DOMAINS = ["example.com", "example.org", "example.net"]


def digest(seed, table: str, field: str, row: Column) -> Column:
    """32 hex digits, uniform over (seed, table, field, row)."""
    return F.md5(F.concat(F.lit(f"{seed}|{table}|{field}|"), row.cast("string")))


def number(hex_digits: Column) -> Column:
    """The first 60 bits of a digest as a non-negative bigint."""
    return F.conv(F.substring(hex_digits, 1, 15), 16, 10).cast("bigint")


def draw(seed, table: str, field: str, row: Column) -> Column:
    return number(digest(seed, table, field, row))


def uuid_text(hex_digits: Column) -> Column:
    """A version-4 shaped uuid."""
    variant = F.translate(
        F.substring(hex_digits, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(hex_digits, 1, 8), F.lit("-"),
        F.substring(hex_digits, 9, 4), F.lit("-4"),
        F.substring(hex_digits, 14, 3), F.lit("-"),
        variant, F.substring(hex_digits, 18, 3), F.lit("-"),
        F.substring(hex_digits, 21, 12),
    )


def uniform_int(h: Column, low: int, high: int) -> Column:
    return F.lit(low).cast("bigint") + h % F.lit(high - low + 1).cast("bigint")


def uniform_cents(h: Column, low: float, high: float) -> Column:
    """A two-decimal double: drawn as whole cents, so no float error creeps in."""
    lo, hi = round(low * 100), round(high * 100)
    return uniform_int(h, lo, hi) / F.lit(100.0)


def letters(h: Column, length: int = TEXT_LENGTH) -> Column:
    """Lowercase letters: the last ``length`` (12 at most) base-26 digits of one draw."""
    digits = F.conv(h % F.lit(26 ** length).cast("bigint"), 10, 26)
    return F.translate(
        F.lpad(digits, length, "0"), "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")


def pick(h: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))


def alias_table(weights) -> tuple[list[int], list[int]]:
    """(limits, others) for a draw in constant time: a slot is kept if 30 uniform bits are below its
    limit, and gives way to its other one if not."""
    n = len(weights)
    exact = [Fraction(w) for w in weights]
    share = [w * n / sum(exact) for w in exact]
    others = list(range(n))
    low, high = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] > 1]
    while low and high:
        short, full = low.pop(), high[-1]
        others[short] = full
        share[full] -= 1 - share[short]  # what the short slot lacks
        if share[full] <= 1:
            high.pop()
            if share[full] < 1:
                low.append(full)
    return [int(x * (1 << 30)) for x in share], others


def pick_weighted(h: Column, weights: dict[str, float]) -> Column:
    """A text with the frequency of its weight, from a draw of 60 bits. Low bits of the draw choose the slot, high bits settle it."""
    limits, others = alias_table(list(weights.values()))
    slot = (h.bitwiseAND(F.lit((1 << 30) - 1)) % len(weights) + 1).cast("int")
    of_slot = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), slot)
    texts = list(weights)
    return F.when(F.shiftright(h, 30) < of_slot(limits), of_slot(texts)).otherwise(of_slot([texts[i] for i in others]))


def pick_from(h: Column, pool) -> Column:
    """One of a list of texts, or of a mapping of texts to weights."""
    return pick_weighted(h, pool) if isinstance(pool, dict) else pick(h, list(pool))


def is_pool(pool) -> bool:
    if isinstance(pool, dict):
        weights = list(pool.values())
        return (all(isinstance(t, str) for t in pool) and any(weights)
                and all(isinstance(w, (int, float)) and not isinstance(w, bool) and math.isfinite(w) and w >= 0 for w in weights))
    return isinstance(pool, list) and len(pool) > 0 and all(isinstance(t, str) for t in pool)


def coin(h: Column) -> Column:
    return h % 2 == 0


def _full_name(seed, table, field, row, first=FIRST_NAMES, last=LAST_NAMES):
    return F.concat_ws(
        " ",
        pick_from(draw(seed, table, field + ".first", row), first),
        pick_from(draw(seed, table, field + ".last", row), last),
    )


def _email(seed, table, field, row, first=FIRST_NAMES, last=LAST_NAMES, domains=MAIL_DOMAINS):
    tail = draw(seed, table, field + ".tail", row)
    # a weighted draw takes all bits of a number
    host = draw(seed, table, field + ".domain", row) if isinstance(domains, dict) else F.shiftright(tail, 16)
    return F.concat(
        F.lower(pick_from(draw(seed, table, field + ".first", row), first)), F.lit("."),
        F.lower(pick_from(draw(seed, table, field + ".last", row), last)),
        (tail % 10000).cast("string"), F.lit("@"), pick_from(host, domains),
    )


def _job_title(seed, table, field, row, values=JOB_TITLES):
    return pick_from(draw(seed, table, field, row), values)


LABELS = {"full_name": _full_name, "email_address": _email, "job_title": _job_title}
# The pools that ``ik_options`` of a label may replace: lists of texts, or texts with weights.
LABEL_OPTIONS = {"full_name": {"first", "last"}, "email_address": {"first", "last", "domains"}, "job_title": {"values"}}


def register_label(name: str, values, options=()) -> None:
    """Make ``key_label: name`` known: ``values`` is a pool (a list of texts, or texts with weights), or a function
    (seed, table, field, row) that gives a column and takes the pools named in ``options`` as keywords."""
    if callable(values):
        LABELS[name], LABEL_OPTIONS[name] = values, set(options)
        return
    pool = values if isinstance(values, dict) else list(values)
    LABELS[name] = lambda seed, table, field, row, values=pool: pick_from(draw(seed, table, field, row), values)
    LABEL_OPTIONS[name] = {"values"}


def percent_of(n: Column, pct) -> Column:
    """Truncating percentage."""
    return F.floor(n * F.lit(float(pct)) / 100).cast("bigint")


def field_value(field: StructField, seed, table: str, row: Column, batch_ts: Column) -> Column:
    """The seeded value of one declared field that is neither a reference nor bookkeeping."""
    meta = field.metadata
    label = meta.get("key_label")
    if label:
        if label not in LABELS:
            raise ValueError(f"invalid_config: unknown key_label '{label}'")
        return LABELS[label](seed, table, field.name, row, **meta.get("ik_options", {}))
    kind = meta["type"]
    if kind == "uuid":
        return uuid_text(digest(seed, table, field.name, row))
    h = draw(seed, table, field.name, row)
    low, high = meta.get("min", DEFAULT_LOW), meta.get("max", DEFAULT_HIGH)
    if kind == "int":
        return uniform_int(h, int(low), int(high))
    if kind == "float":
        return uniform_cents(h, low, high)
    if kind == "string":
        return letters(h)
    if kind == "enum":
        return pick(h, list(meta["values"]))
    if kind == "bool":
        return coin(h)
    if kind == "timestamp":
        return batch_ts
    raise ValueError(f"invalid_config: no generator for type '{kind}'")
