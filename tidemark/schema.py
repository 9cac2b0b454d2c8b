"""Declared tables: a config dict becomes a StructType with the extras in field metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql.types import (
    BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from tidemark.functions.draws import LABEL_OPTIONS, LABELS, is_pool
from tidemark.functions.text import (
    FIELD_NAME_PATTERN, RESERVED_TABLE_NAMES, TABLE_NAME_PATTERN,
)

# The column types, bookkeeping roles and cadences a config may name.
COLUMN_TYPES = {
    "uuid": StringType(), "int": LongType(), "float": DoubleType(), "string": StringType(),
    "enum": StringType(), "bool": BooleanType(), "timestamp": TimestampNTZType(),
    "ref": StringType(),
}
AUTO_ROLES = ["created", "updated", "soft_delete", "version"]
CADENCES = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 days"}

# Bounds a caller may set on declared tables (``declare(limits=...)``); none by default.
LIMITS = {"fields", "enum_values", "enum_value_length", "initial_count", "new_records"}

_FIELD_KEYS = {
    "type", "primary_key", "nullable", "min", "max", "values", "ref_entity", "auto", "key_label",
    "ik_options",
}
_SCHEDULE_KEYS = {
    "cadence", "new_records", "mutate_existing_pct", "soft_delete_pct", "jitter_seconds",
}


@dataclass(frozen=True)
class Table:
    """One declared table. Plain data: every operator takes it as an argument."""

    name: str
    schema: StructType
    initial_count: int = 50
    cadence: str = "hourly"
    new_records: tuple[int, int] = (0, 0)
    mutate_pct: float = 0.0
    delete_pct: float = 0.0
    max_rows: int | None = None

    def _having(self, test) -> list[StructField]:
        return [f for f in self.schema.fields if test(f.metadata)]

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def pk(self) -> str:
        return self._having(lambda m: m.get("primary_key"))[0].name

    @property
    def soft_delete(self) -> str | None:
        found = self._having(lambda m: m.get("auto") == "soft_delete")
        return found[0].name if found else None

    @property
    def refs(self) -> dict[str, str]:
        """Reference field -> parent table."""
        return {f.name: f.metadata["ref_entity"]
                for f in self._having(lambda m: m["type"] == "ref")}

    @property
    def parents(self) -> set[str]:
        return set(self.refs.values())

    @property
    def mutable(self) -> list[StructField]:
        """What an update rewrites: neither key, nor reference, nor bookkeeping."""
        return self._having(
            lambda m: not m.get("primary_key") and not m.get("auto") and m["type"] != "ref")

    @property
    def writable(self) -> list[StructField]:
        """What a payload may carry."""
        return self._having(lambda m: not m.get("primary_key") and not m.get("auto"))

    def autos(self, role: str) -> list[str]:
        return [f.name for f in self._having(lambda m: m.get("auto") == role)]


def _refuse(message: str):
    raise ValueError(f"invalid_config: {message}")


def _check(ok: bool, message: str) -> None:
    if not ok:
        _refuse(message)


def _field(name: str, spec: dict, table: str, siblings, limits: dict) -> StructField:
    where = f"field '{name}'"
    _check(bool(re.match(FIELD_NAME_PATTERN, name)), f"{where} is not a plain lowercase name")
    _check(not set(spec) - _FIELD_KEYS, f"{where} has keys {sorted(set(spec) - _FIELD_KEYS)}")
    kind, auto = spec.get("type"), spec.get("auto")
    _check(kind in COLUMN_TYPES, f"{where}: type '{kind}' is not one of {sorted(COLUMN_TYPES)}")
    _check(auto is None or auto in AUTO_ROLES, f"{where}: auto '{auto}' is not known")
    _check(auto not in AUTO_ROLES[:3] or kind == "timestamp", f"{where}: auto {auto} is a timestamp")
    _check((auto == "version") == (name == "version") and (auto != "version" or kind == "int"),
           f"{where}: the change counter is 'version', type int, auto version")
    values = spec.get("values")
    if kind == "enum":
        _check(
            isinstance(values, list) and 0 < len(values) <= limits.get("enum_values", len(values))
            and len(set(values)) == len(values)
            and all(isinstance(v, str) and 0 < len(v) <= limits.get("enum_value_length", len(v)) for v in values),
            f"{where}: an enum lists distinct texts, within the limits set")
    else:
        _check(values is None, f"{where}: only an enum has values")
    parent = spec.get("ref_entity")
    if kind == "ref":
        _check(not spec.get("primary_key"), f"{where}: a key cannot be a reference")
        _check(parent != table, f"{where}: a table cannot reference itself")
        _check(parent in siblings, f"{where}: parent '{parent}' is not in {sorted(siblings)}")
    else:
        _check(parent is None, f"{where}: only a ref has ref_entity")
    low, high = spec.get("min"), spec.get("max")
    _check(low is None or high is None or low <= high, f"{where}: min is above max")
    label = spec.get("key_label")
    _check(label is None or label in LABELS, f"{where}: unknown key_label '{label}'")
    options = spec.get("ik_options")
    _check(options is None or label is not None, f"{where}: ik_options needs a key_label")
    _check(options is None or isinstance(options, dict), f"{where}: ik_options is a mapping")
    unknown = set(options or {}) - LABEL_OPTIONS.get(label, set())
    _check(not unknown, f"{where}: label '{label}' has no options {sorted(map(str, unknown))}")
    for option, pool in (options or {}).items():
        _check(is_pool(pool), f"{where}: option '{option}' is a list of texts, or texts with weights")
    kept = {k: v for k, v in spec.items() if v is not None}
    nullable = bool(spec.get("nullable")) or auto == "soft_delete"
    return StructField(name, COLUMN_TYPES[kind], nullable, metadata={**kept, "nullable": nullable})


def declare(config: dict, siblings=(), max_rows: int | None = None, limits: dict | None = None) -> Table:
    """Check a config and turn it into a Table. ``siblings`` are the names it may reference,
    ``limits`` bounds by the names in LIMITS."""
    limits = dict(limits or {})
    _check(not set(limits) - LIMITS, f"unknown limits {sorted(set(limits) - LIMITS)}")
    name = config.get("entity") or config.get("name")
    _check(isinstance(name, str) and bool(re.match(TABLE_NAME_PATTERN, name)),
           f"'{name}' is not a plain lowercase table name")
    _check(name not in RESERVED_TABLE_NAMES, f"'{name}' is a reserved name")
    # failure_injection is for services that simulate faults; it says nothing about the data
    extra = set(config) - {"entity", "name", "fields", "seed", "update_schedule", "failure_injection"}
    _check(not extra, f"unknown keys {sorted(extra)}")
    specs = config.get("fields")
    _check(isinstance(specs, dict) and len(specs) > 0, "fields must be a non-empty mapping")
    if "version" not in specs:
        specs = {**specs, "version": {"type": "int", "auto": "version"}}
    _check(len(specs) <= limits.get("fields", len(specs)), f"more than {limits.get('fields')} fields")
    fields = [_field(n, s, name, set(siblings), limits) for n, s in specs.items()]
    keys = [f for f in fields if f.metadata.get("primary_key")]
    _check(len(keys) == 1, "exactly one field is the primary key")
    _check(keys[0].metadata["type"] == "uuid" and not keys[0].metadata.get("auto"),
           "the primary key is a plain uuid")
    _check(sum(f.metadata.get("auto") == "soft_delete" for f in fields) <= 1,
           "at most one soft_delete field")

    count = config.get("seed", {}).get("initial_count", 50)
    _check(0 <= count <= limits.get("initial_count", count), "initial_count is negative or beyond its limit")
    plan = config.get("update_schedule", {})
    _check(not set(plan) - _SCHEDULE_KEYS, "unknown update_schedule keys")
    cadence = plan.get("cadence", "hourly")
    _check(cadence in CADENCES, f"cadence '{cadence}' is not one of {sorted(CADENCES)}")
    low, high = plan.get("new_records", (0, 0))
    _check(0 <= low <= high <= limits.get("new_records", high), "new_records is a low, high pair in range")
    mutate, delete = plan.get("mutate_existing_pct", 0.0), plan.get("soft_delete_pct", 0.0)
    _check(0 <= mutate <= 100 and 0 <= delete <= 100, "percentages lie between 0 and 100")
    return Table(name, StructType(fields), count, cadence, (low, high), mutate, delete, max_rows)


def load_order(tables: dict[str, Table]) -> list[str]:
    """Parents first, ties by name: the declared graph is a handful of names."""
    level: dict[str, int] = {}

    def depth(name: str, trail: tuple[str, ...]) -> int:
        _check(name not in trail, f"circular reference through '{name}'")
        if name not in level:
            above = [depth(p, (*trail, name)) for p in tables[name].parents if p in tables]
            level[name] = 1 + max(above, default=-1)
        return level[name]

    return sorted(tables, key=lambda n: (depth(n, ()), n))


def with_dependents(tables: dict[str, Table], names) -> set[str]:
    """``names`` and every table that references one of them, however indirectly."""
    chosen = set(names)
    for name in load_order(tables):
        if tables[name].parents & chosen:
            chosen.add(name)
    return chosen
