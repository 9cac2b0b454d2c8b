"""Bulk validation and audits (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import generate, validation
from tidemark.plans.catalog import LOG, ORD, ORDERS, SOLVENT, Roles, query

# One payload per event; which rule it tests follows from its number.
PAYLOADS = """pay AS (
  SELECT event_id AS row_pos, CASE event_id % 15
    WHEN 0 THEN '{"amount": ' || CAST(value AS VARCHAR) || ', "note": null}'
    WHEN 1 THEN '{"colour": [3], "amount": "n/a"}'
    WHEN 2 THEN '{"order_id": "A-17"}'
    WHEN 3 THEN '{"amount": 61.5, "version": 902}'
    WHEN 4 THEN '{"amount": "61,50", "colour": {}}'
    WHEN 5 THEN '{"amount": false}'
    WHEN 6 THEN '{"status": "Q"}'
    WHEN 7 THEN '{"note": null, "amount": null}'
    WHEN 8 THEN '{"customer_id": 4001}'
    WHEN 9 THEN '{"customer_id": "' || user_id || '"}'
    WHEN 10 THEN '{"placed_at": "Easter Monday"}'
    WHEN 11 THEN '{"priority": 3.0}'
    WHEN 12 THEN '{"urgent": "no", "deleted_at": "1999-12-31T08:15:00Z"}'
    WHEN 13 THEN '{"status": "O", "priority": 3, "urgent": false, "placed_at": "2011-07-09T16:45:30Z", "note": "' || event_type || '"}'
    ELSE '[' || event_id || ']' END AS payload
  FROM events)"""

_NAMES = ", ".join(f"'{c}'" for c in ORDERS.columns)
_FIXED = "'order_id', 'updated_at', 'deleted_at', 'version'"
_IS_OBJECT = "json_type(payload) = 'OBJECT'"

# The rules over one (payload, key) pair, written against DuckDB's JSON types.
_PAIRS = f"""{PAYLOADS}, {SOLVENT}, keyed AS (
  SELECT row_pos, payload, unnest(json_keys(payload)) AS key, generate_subscripts(json_keys(payload), 1) AS place
  FROM pay WHERE {_IS_OBJECT}),
pairs AS (SELECT *, json_type(payload, '$.' || key) AS kind, json_extract_string(payload, '$.' || key) AS val FROM keyed),
judged AS (
  SELECT *, CASE
    WHEN key NOT IN ({_NAMES}) THEN 'unknown_field'
    WHEN key IN ({_FIXED}) THEN 'read_only_field'
    WHEN kind = 'NULL' THEN CASE WHEN key <> 'note' THEN 'invalid_value' END
    WHEN key = 'amount' AND kind NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'invalid_value'
    WHEN key = 'priority' AND kind NOT IN ('UBIGINT', 'BIGINT') THEN 'invalid_value'
    WHEN key = 'urgent' AND kind <> 'BOOLEAN' THEN 'invalid_value'
    WHEN key IN ('customer_id', 'status', 'note', 'placed_at') AND kind <> 'VARCHAR' THEN 'invalid_value'
    WHEN key = 'status' AND val NOT IN ('F', 'O', 'P') THEN 'invalid_value'
    WHEN key = 'placed_at' AND try_cast(val AS TIMESTAMPTZ) IS NULL THEN 'invalid_value'
    WHEN key = 'customer_id' AND val NOT IN (SELECT customer_id FROM cust) THEN 'invalid_reference'
  END AS code FROM pairs)"""


def _payloads(t: Roles):
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    texts = [
        F.concat(F.lit('{"amount": '), value, F.lit(', "note": null}')),
        F.lit('{"colour": [3], "amount": "n/a"}'),
        F.lit('{"order_id": "A-17"}'),
        F.lit('{"amount": 61.5, "version": 902}'),
        F.lit('{"amount": "61,50", "colour": {}}'),
        F.lit('{"amount": false}'),
        F.lit('{"status": "Q"}'),
        F.lit('{"note": null, "amount": null}'),
        F.lit('{"customer_id": 4001}'),
        F.concat(F.lit('{"customer_id": "'), user, F.lit('"}')),
        F.lit('{"placed_at": "Easter Monday"}'),
        F.lit('{"priority": 3.0}'),
        F.lit('{"urgent": "no", "deleted_at": "1999-12-31T08:15:00Z"}'),
        F.concat(F.lit('{"status": "O", "priority": 3, "urgent": false, "placed_at": "2011-07-09T16:45:30Z", "note": "'),
                 F.col("event_type"), F.lit('"}')),
        F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")),
    ]
    text = texts[-1]
    for i in range(len(texts) - 1):
        text = F.when(F.col("event_id") % 15 == i, texts[i]).otherwise(text)
    return t.tab("events").select(F.col("event_id").alias("row_pos"), text.alias("payload"))


def _parents(t: Roles):
    return {"customers": (t.solvent.select("customer_id"), "customer_id")}


def _names(keys):
    return F.array_join(F.array_sort(keys), ",")


@query("v1_unknown_fields", f"""
WITH {_PAIRS} SELECT row_pos, (SELECT coalesce(string_agg(key, ',' ORDER BY key), '') FROM judged j
  WHERE j.row_pos = p.row_pos AND code = 'unknown_field') AS unknown FROM pay p WHERE {_IS_OBJECT}""")
def _(t):
    named = _payloads(t).select("row_pos", _names(validation.unknown_keys(F.col("payload"), ORDERS)).alias("unknown"))
    return named.filter("unknown IS NOT NULL")


@query("v2_read_only_fields", f"""
WITH {_PAIRS} SELECT row_pos, (SELECT coalesce(string_agg(key, ',' ORDER BY key), '') FROM judged j
  WHERE j.row_pos = p.row_pos AND code = 'read_only_field') AS read_only FROM pay p WHERE {_IS_OBJECT}""")
def _(t):
    named = _payloads(t).select("row_pos", _names(validation.read_only_keys(F.col("payload"), ORDERS)).alias("read_only"))
    return named.filter("read_only IS NOT NULL")


def _flag(t: Roles, rule, field: str, of=validation.json_type):
    """One rule on one field; rows without that field pass."""
    parsed = validation.parsed_fields(F.col("payload"))
    seen = _payloads(t).withColumn("_seen", of(parsed, field))
    return seen.select("row_pos", rule(F.col("_seen"), ORDERS.schema[field]).alias("is_bad"))


def _flag_sql(condition: str) -> str:
    return f"""WITH {PAYLOADS} SELECT row_pos, coalesce({_IS_OBJECT} AND ({condition}), FALSE) AS is_bad FROM pay"""


@query("v3_wrong_type_amount", _flag_sql(
    "json_type(payload, '$.amount') NOT IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE')"))
def _(t):
    return _flag(t, validation.has_wrong_type, "amount")


@query("v3_wrong_type_priority", _flag_sql("json_type(payload, '$.priority') NOT IN ('NULL', 'UBIGINT', 'BIGINT')"))
def _(t):
    return _flag(t, validation.has_wrong_type, "priority")


@query("v3_wrong_type_urgent", _flag_sql("json_type(payload, '$.urgent') NOT IN ('NULL', 'BOOLEAN')"))
def _(t):
    return _flag(t, validation.has_wrong_type, "urgent")


@query("v3_wrong_type_reference", _flag_sql("json_type(payload, '$.customer_id') NOT IN ('NULL', 'VARCHAR')"))
def _(t):
    return _flag(t, validation.has_wrong_type, "customer_id")


@query("v4_null_in_required", _flag_sql("json_type(payload, '$.amount') = 'NULL'"))
def _(t):
    return _flag(t, validation.is_null_in_required, "amount")


@query("v5_enum_membership", _flag_sql("json_extract_string(payload, '$.status') NOT IN ('F', 'O', 'P')"))
def _(t):
    return _flag(t, validation.is_not_listed, "status", validation.json_text)


@query("v6_not_a_time", _flag_sql(
    "json_extract_string(payload, '$.placed_at') IS NOT NULL AND try_cast(json_extract_string(payload, '$.placed_at') AS TIMESTAMPTZ) IS NULL"))
def _(t):
    return _flag(t, validation.is_not_a_time, "placed_at", validation.json_text)


@query("v7_invalid_references", f"""
WITH {_PAIRS} SELECT row_pos, val AS customer_id FROM judged WHERE code = 'invalid_reference'""")
def _(t):
    parsed = _payloads(t).withColumn("_parsed", validation.parsed_fields(F.col("payload")))
    wanted = parsed.filter(validation.json_type(F.col("_parsed"), "customer_id") == "STRING").select(
        "row_pos", validation.json_text(F.col("_parsed"), "customer_id").alias("customer_id"))
    return validation.dangling_refs(wanted, "customer_id", t.solvent, "customer_id")


@query("v8_first_errors", f"""
WITH {_PAIRS}, worst AS (
  SELECT row_pos, arg_min(code, place) AS code, arg_min(key, place) AS key FROM judged WHERE code IS NOT NULL GROUP BY 1)
SELECT row_pos, payload, CASE WHEN NOT {_IS_OBJECT} THEN 'invalid_json' ELSE code END AS error_code, key AS error_field
FROM pay LEFT JOIN worst USING (row_pos)""")
def _(t):
    return validation.validate(_payloads(t), ORDERS, _parents(t)).drop("message")


@query("v8_first_failure", f"""
WITH {_PAIRS}, bad AS (
  SELECT row_pos FROM judged WHERE code IS NOT NULL UNION SELECT row_pos FROM pay WHERE NOT {_IS_OBJECT}),
first AS (SELECT min(row_pos) AS p, count(*) AS n FROM bad)
SELECT (SELECT count(*) FROM pay) AS n_rows, n AS n_bad, p AS first_bad,
       (SELECT arg_min(code, place) FROM judged WHERE row_pos = p AND code IS NOT NULL) AS error_code,
       'rows[' || p || ']: colour is not a field of this table' AS message FROM first""")
def _(t):
    return validation.first_failure(validation.validate(_payloads(t), ORDERS, _parents(t)))


@query("v9_request_size", f"""
WITH {ORD} SELECT count(*) AS n_rows, count(*) + (SELECT count(*) FROM ord) AS rows_after,
  CASE WHEN count(*) > 100000 THEN 'too_many_rows' WHEN count(*) + (SELECT count(*) FROM ord) > 20000 THEN 'quota_exceeded'
       ELSE 'ok' END AS status FROM events""")
def _(t):
    return validation.request_size(_payloads(t), F.lit(t.orders.count()).cast("bigint"), 20_000, limit=100_000)


@query("v10_version_audit", f"""
WITH {LOG}, kept AS (
  SELECT entity, version FROM chg WHERE op <> 'insert' UNION ALL SELECT entity, version FROM chg WHERE op = 'delete'
  UNION ALL SELECT 'whole ' || entity, version FROM chg),
d AS (SELECT DISTINCT entity, version FROM kept),
steps AS (SELECT entity, version - lag(version) OVER (PARTITION BY entity ORDER BY version) AS step FROM d),
g AS (SELECT entity, count(*) FILTER (step > 1) AS n_gaps FROM steps GROUP BY 1)
SELECT entity, count(*) AS n_entries, min(version) AS first_version, max(version) AS last_version,
       count(*) - count(DISTINCT version) AS n_duplicates, any_value(n_gaps) AS n_gaps,
       any_value(n_gaps) = 0 AND count(*) = count(DISTINCT version) AS is_contiguous
FROM kept JOIN g USING (entity) GROUP BY entity""")
def _(t):
    """A log with holes and repeats next to the sound one."""
    broken = t.log.filter("op <> 'insert'").unionByName(t.log.filter("op = 'delete'"))
    sound = t.log.withColumn("entity", F.concat(F.lit("whole "), "entity"))
    return validation.version_audit(broken.unionByName(sound), bits=10)


@query("v10_repeated_keys", """
SELECT l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    keyed = t.tab("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"))
    return generate.repeated_keys(keyed, "key")
