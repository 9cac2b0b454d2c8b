"""Checking bulk payloads and auditing tables against their log.

A payload frame holds ``row_pos`` (unique integers) and ``payload`` (JSON text). Every rule
is a column, so one pass over the payloads finds the first error of each row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, TimestampNTZType

from tidemark.functions.text import is_iso, parse_iso
from tidemark.operators.skew import broadcast_limit, join_unique, plan_bytes
from tidemark.schema import Table
from tidemark.session import pin

UNKNOWN, READ_ONLY, INVALID, BAD_REF, BAD_JSON = (
    "unknown_field", "read_only_field", "invalid_value", "invalid_reference", "invalid_json")

_EXPECTED = {
    "string": "a string", "uuid": "a string", "ref": "a string", "int": "an integer",
    "float": "a number", "bool": "true or false", "timestamp": "an ISO 8601 timestamp",
    "enum": "one of the listed values",
}


def keys_of(payload: Column) -> Column:
    """Top-level keys in document order; NULL unless the text is a JSON object."""
    return F.json_object_keys(payload)


def unknown_keys(payload: Column, table: Table) -> Column:
    return F.array_except(keys_of(payload), F.array(*[F.lit(c) for c in table.columns]))


def read_only_keys(payload: Column, table: Table) -> Column:
    writable = {f.name for f in table.writable}
    fixed = [F.lit(c) for c in table.columns if c not in writable]
    return F.array_intersect(keys_of(payload), F.array(*fixed))


def parsed_fields(payload: Column) -> Column:
    """The payload's fields as a map of variants: one parse, JSON types and the order of keys kept; NULL
    unless the text is a JSON object."""
    return F.from_json(payload, "map<string,variant>")


def json_type(parsed: Column, name: str) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID for null, NULL if absent."""
    return F.schema_of_variant(F.element_at(parsed, name))


def json_text(parsed: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.element_at(parsed, name), "$", kind)


# The rules below see one field as two columns: ``found``, its JSON type, and ``text``.
def is_null_in_required(found: Column, field: StructField) -> Column:
    return F.lit(False) if field.metadata.get("nullable") else F.coalesce(found == "VOID", F.lit(False))


def has_wrong_type(found: Column, field: StructField) -> Column:
    """The JSON type does not fit the declared one. Integers take no booleans and no 7.0."""
    fits = {
        "int": "^(VOID|BIGINT)$", "float": r"^(VOID|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
        "bool": "^(VOID|BOOLEAN)$",
    }.get(field.metadata["type"], "^(VOID|STRING)$")
    return F.coalesce(~found.rlike(fits), F.lit(False))


def is_not_listed(text: Column, field: StructField) -> Column:
    return F.coalesce(~text.isin(list(field.metadata["values"])), F.lit(False))


def is_not_a_time(text: Column, field: StructField) -> Column:
    return text.isNotNull() & ~is_iso(text)


def _wrong_value(found: Column, text: Column, field: StructField) -> Column:
    bad = is_null_in_required(found, field) | has_wrong_type(found, field)
    if field.metadata["type"] == "enum":
        bad = bad | is_not_listed(text, field)
    if field.metadata["type"] == "timestamp":
        bad = bad | is_not_a_time(text, field)
    return bad


def with_known_parents(read: DataFrame, table: Table,
                       parents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Adds ``_lost_<ref>``: the reference in ``_text_<ref>`` names no parent row.

    Before a parent that is too large to broadcast, what has been read is stored: the join then reads it
    twice (hot references and the rest) and no payload is parsed again.
    """
    out = read
    for ref, parent in table.refs.items():
        keys, pk = parents[parent]
        known = keys.select(F.col(pk).cast("string").alias("_known"))
        if plan_bytes(known) > broadcast_limit(known):
            out = pin(out, "read")
        out = join_unique(out, known, f"_text_{ref}", "_known")
        out = out.withColumn(f"_lost_{ref}", F.col(f"_text_{ref}").isNotNull() & F.col("_known").isNull()).drop("_known")
    return out


def read_payloads(payloads: DataFrame, table: Table, given: bool = False) -> DataFrame:
    """What the rules look at, from one parse of each payload: the JSON types, texts and places of its fields,
    its first unknown key, and with ``given`` the fields' values and presence (an explicit null is given too)."""
    fields, keys = F.col("_fields"), F.col("_keys")
    once = payloads.withColumn("_fields", parsed_fields(F.col("payload"))).withColumn(
        # a repeated key makes an object invalid
        "_keys", F.when(F.size(F.array_distinct(F.map_keys("_fields"))) == F.size(F.map_keys("_fields")), F.map_keys("_fields")))
    as_text = {f.name for f in table.writable if f.metadata["type"] in ("enum", "timestamp")} | set(table.refs)
    columns = {
        **{f"_type_{f.name}": json_type(fields, f.name) for f in table.writable},
        **{f"_text_{c}": json_text(fields, c) for c in as_text},
        **{f"_at_{c}": F.array_position(keys, c) for c in table.columns},
        "_stranger": F.get(F.array_except(keys, F.array(*[F.lit(c) for c in table.columns])), F.lit(0))}
    if given:
        for f in table.writable:
            is_time = isinstance(f.dataType, TimestampNTZType)
            value = json_text(fields, f.name, "string" if is_time else f.dataType.simpleString())
            columns[f"_given_{f.name}"] = parse_iso(value) if is_time else value
            columns[f"_has_{f.name}"] = F.array_contains(keys, f.name)
    return once.withColumns(columns).drop("_fields")


def _message(code: Column, field: Column, table: Table) -> Column:
    expected = F.lit(None).cast("string")
    for f in table.schema.fields:
        expected = F.when(field == f.name, _EXPECTED[f.metadata["type"]]).otherwise(expected)
    return (
        F.when(code == UNKNOWN, F.concat(field, F.lit(" is not a field of this table")))
        .when(code == READ_ONLY, F.concat(field, F.lit(" is set by the system")))
        .when(code == BAD_REF, F.concat(field, F.lit(" names no existing row")))
        .when(code == BAD_JSON, F.lit("the payload is not a JSON object"))
        .when(code == INVALID, F.concat(field, F.lit(" must be "), expected)))


def validate(payloads: DataFrame, table: Table,
             parents: Mapping[str, tuple[DataFrame, str]] | None = None, given: bool = False) -> DataFrame:
    """Each payload with its first error in key order: ``error_code``, ``error_field`` and
    ``message``, all NULL when the payload is good; with ``given`` also its fields, see ``read_payloads``.

    Every field contributes (position in the payload, code, name) if it is wrong, and the
    least of these is the verdict: plain columns, no lambdas, one parse per payload.
    """
    checked = read_payloads(payloads, table, given)
    if table.refs:
        checked = with_known_parents(checked, table, parents)
    none = F.lit(None).cast("string")

    def code_of(f: StructField) -> Column:
        text = F.col(f"_text_{f.name}") if f.metadata["type"] in ("enum", "timestamp") else none
        code = F.when(_wrong_value(F.col(f"_type_{f.name}"), text, f), INVALID)
        return F.coalesce(code, F.when(F.col(f"_lost_{f.name}"), BAD_REF)) if f.name in table.refs else code

    writable = {f.name for f in table.writable}
    checked = checked.withColumns({f"_code_{f.name}": code_of(f) for f in table.writable} | {
        "_at": F.array_position(F.col("_keys"), F.col("_stranger"))})

    def error_at(place: Column, code: Column, name: Column) -> Column:
        return F.when((place > 0) & code.isNotNull(), F.struct(
            place.alias("place"), code.alias("code"), name.alias("field")))

    errors = [error_at(F.col("_at"), F.lit(UNKNOWN), F.col("_stranger"))]
    errors += [
        error_at(F.col(f"_at_{c}"), F.col(f"_code_{c}") if c in writable else F.lit(READ_ONLY), F.lit(c))
        for c in table.columns]
    first = F.when(F.col("_keys").isNull(), F.struct(
        F.lit(0).cast("bigint").alias("place"), F.lit(BAD_JSON).alias("code"), none.alias("field"))).otherwise(F.least(*errors))
    kept = [*payloads.columns, *(f"_{w}_{f.name}" for f in table.writable for w in ("given", "has") if given)]
    verdict = checked.select(*kept, first.alias("_first")).select(
        *kept, F.col("_first.code").alias("error_code"), F.col("_first.field").alias("error_field"))
    return verdict.withColumn("message", _message(F.col("error_code"), F.col("error_field"), table))


def first_failure(checked: DataFrame) -> DataFrame:
    """The verdict on a whole batch in one pass: its first bad row, or nothing wrong."""
    bad = F.when(F.col("error_code").isNotNull(), F.col("row_pos"))
    where = F.concat(F.lit("rows["), F.col("row_pos").cast("string"), F.lit("]: "), F.col("message"))
    return checked.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(bad).alias("n_bad"), F.min(bad).alias("first_bad"),
        F.min_by("error_code", bad).alias("error_code"), F.min_by(where, bad).alias("message"))


def request_size(payloads: DataFrame, existing_rows: Column | int, max_rows: int | None,
                 limit: int | None = None) -> DataFrame:
    """Row limit (if any) and quota of a bulk request in one row."""
    rows = F.count(F.lit(1))
    after = rows + existing_rows
    over = F.lit(False) if max_rows is None else after > max_rows
    too_many = F.lit(False) if limit is None else rows > limit
    return payloads.agg(
        rows.alias("n_rows"), after.alias("rows_after"),
        F.when(too_many, "too_many_rows").when(over, "quota_exceeded").otherwise("ok").alias("status"))


# ----------------------------------------------------------------------- audit
def version_audit(log: DataFrame, bits: int = 20) -> DataFrame:
    """Per entity: count, span, duplicates and gaps of the versions in the log.

    Neighbours are compared inside buckets of ``2**bits`` versions; across buckets only
    their ends are. An entity that owns most of the log is spread like the rest.
    """
    distinct = log.groupBy("entity", "version").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", F.shiftright(F.col("version").cast("bigint"), bits))
    step = F.col("version") - F.lag("version").over(
        Window.partitionBy("entity", "_bucket").orderBy("version"))
    buckets = distinct.withColumn("_step", step).groupBy("entity", "_bucket").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_versions"),
        F.min("version").alias("_low"), F.max("version").alias("_high"),
        F.count_if(F.col("_step") > 1).alias("_gaps"))
    jump = F.col("_low") - F.lag("_high").over(Window.partitionBy("entity").orderBy("_bucket"))
    return buckets.withColumn("_jump", jump).groupBy("entity").agg(
        F.sum("_rows").alias("n_entries"),
        F.min("_low").alias("first_version"), F.max("_high").alias("last_version"),
        (F.sum("_rows") - F.sum("_versions")).alias("n_duplicates"),
        (F.sum("_gaps") + F.count_if(F.col("_jump") > 1)).alias("n_gaps"),
    ).withColumn("is_contiguous", (F.col("n_gaps") == 0) & (F.col("n_duplicates") == 0))


def dangling_refs(rows: DataFrame, ref: str, parents: DataFrame, pk: str) -> DataFrame:
    """Rows whose reference names no parent row; NULL references pass."""
    known = parents.select(F.col(pk).alias("_known"))
    return join_unique(rows.filter(F.col(ref).isNotNull()), known, ref, "_known", "left_anti")
