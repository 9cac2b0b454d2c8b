"""Scalar functions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import draws, text
from tidemark.plans.catalog import (
    BATCH_TS, TS, Roles, draw_sql, email_sql, job_sql, letters_sql, name_sql, pick_sql, query, uuid_sql,
)
from tidemark.schema import declare


def K():
    return F.col("o_orderkey")


def _orders(t: Roles):
    return t.tab("orders")


@query("h1_uuid_text", f"SELECT o_orderkey, {uuid_sql(7, 'orders', 'id', 'o_orderkey')} AS id FROM orders")
def _(t):
    return _orders(t).select("o_orderkey", draws.uuid_text(draws.digest(7, "orders", "id", K())).alias("id"))


@query("h2_uniform_int", f"""
SELECT o_orderkey, 1 + {draw_sql(7, 'orders', 'priority', 'o_orderkey')} % 5 AS priority,
       {draw_sql(7, 'orders', 'plain', 'o_orderkey')} % 1001 AS plain FROM orders""")
def _(t):
    return _orders(t).select(
        "o_orderkey",
        draws.uniform_int(draws.draw(7, "orders", "priority", K()), 1, 5).alias("priority"),
        draws.uniform_int(draws.draw(7, "orders", "plain", K()), draws.DEFAULT_LOW, draws.DEFAULT_HIGH).alias("plain"))


@query("h3_uniform_cents", f"""
SELECT o_orderkey, (1000 + {draw_sql(7, 'orders', 'amount', 'o_orderkey')} % 49001) / 100.0::DOUBLE AS amount
FROM orders""")
def _(t):
    return _orders(t).select(
        "o_orderkey", draws.uniform_cents(draws.draw(7, "orders", "amount", K()), 10, 500).alias("amount"))


@query("h4_letters", f"SELECT o_orderkey, {letters_sql(draw_sql(7, 'orders', 'note', 'o_orderkey'))} AS note FROM orders")
def _(t):
    return _orders(t).select("o_orderkey", draws.letters(draws.draw(7, "orders", "note", K())).alias("note"))


@query("h5_enum_pick", f"""
SELECT o_orderkey, {pick_sql(draw_sql(7, 'orders', 'status', 'o_orderkey'), ['pending', 'shipped', 'cancelled'])} AS status
FROM orders""")
def _(t):
    return _orders(t).select("o_orderkey", draws.pick(
        draws.draw(7, "orders", "status", K()), ["pending", "shipped", "cancelled"]).alias("status"))


@query("h6_coin", f"SELECT o_orderkey, {draw_sql(7, 'orders', 'flag', 'o_orderkey')} % 2 = 0 AS flag FROM orders")
def _(t):
    return _orders(t).select("o_orderkey", draws.coin(draws.draw(7, "orders", "flag", K())).alias("flag"))


@query("h7_batch_time", f"SELECT o_orderkey, {TS} AS created_at, '{BATCH_TS.replace(' ', 'T')}' AS created_text FROM orders")
def _(t):
    return _orders(t).select("o_orderkey", t.ts.alias("created_at"), text.iso_text(t.ts).alias("created_text"))


@query("h8_labelled_values", f"""
SELECT o_orderkey, {name_sql(7, 'people', 'name', 'o_orderkey')} AS full_name,
       {email_sql(7, 'people', 'name', 'o_orderkey')} AS email_address,
       {job_sql(7, 'people', 'job', 'o_orderkey')} AS job_title FROM orders""")
def _(t):
    label = draws.LABELS
    return _orders(t).select(
        "o_orderkey", label["full_name"](7, "people", "name", K()).alias("full_name"),
        label["email_address"](7, "people", "name", K()).alias("email_address"),
        label["job_title"](7, "people", "job", K()).alias("job_title"))


# Labels with options: weighted and replaced pools, as a declared table draws them.
_MOODS = {"calm": 6, "brisk": 3, "stormy": 0.5, "never": 0}
_CREW = {"entity": "crew", "fields": {
    "crew_id": {"type": "uuid", "primary_key": True},
    "mood": {"type": "string", "key_label": "job_title", "ik_options": {"values": _MOODS}},
    "mate": {"type": "string", "key_label": "full_name", "ik_options": {"first": ["Ann", "Bo", "Cy"]}}}}


def _mood_sql(h: str) -> str:
    limits, others = draws.alias_table(list(_MOODS.values()))
    names, slot = list(_MOODS), f"({h} & {(1 << 30) - 1}) % {len(_MOODS)} + 1"
    return f"CASE WHEN {h} >> 30 < {limits}[{slot}] THEN {names}[{slot}] ELSE {[names[i] for i in others]}[{slot}] END"


@query("h8_label_options", f"""
SELECT o_orderkey, {_mood_sql(f"({draw_sql(7, 'crew', 'mood', 'o_orderkey')})")} AS mood,
       {pick_sql(draw_sql(7, 'crew', 'mate.first', 'o_orderkey'), ['Ann', 'Bo', 'Cy'])} || ' ' ||
       {pick_sql(draw_sql(7, 'crew', 'mate.last', 'o_orderkey'), draws.LAST_NAMES)} AS mate FROM orders""")
def _(t):
    fields = declare(_CREW).schema
    return _orders(t).select("o_orderkey", *[
        draws.field_value(fields[c], 7, "crew", K(), BATCH_TS).alias(c) for c in ("mood", "mate")])


@query("h9_iso_text", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
       CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS ts_text,
       strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS hour_text FROM events""")
def _(t):
    return t.tab("events").select(
        "event_id", text.iso_text(F.col("ts")).alias("ts_text"),
        text.iso_text(F.date_trunc("hour", "ts")).alias("hour_text"))


@query("h10_parse_iso", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
         WHEN 3 THEN date_trunc('day', ts) END AS parsed FROM events""")
def _(t):
    second = F.date_trunc("second", "ts").cast("timestamp_ntz").cast("string")
    wire = F.replace(second, F.lit(" "), F.lit("T"))
    kind = F.col("event_id") % 5
    shown = (
        F.when(kind == 0, F.concat(wire, F.lit("Z"))).when(kind == 1, second)
        .when(kind == 2, F.concat(wire, F.lit("+02:00"))).when(kind == 3, F.substring(second, 1, 10))
        .otherwise(F.concat(F.lit("not a time "), second)))
    return t.tab("events").select("event_id", text.parse_iso(shown).alias("parsed"))


@query("h11_sql_literals", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'NULL' ELSE '''' || replace(o_orderpriority, '''', '''''') || '''' END AS text_literal,
       CAST(o_totalprice AS VARCHAR) AS number_literal,
       '''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''' AS time_literal,
       CASE WHEN o_orderstatus = 'P' THEN 'TRUE' ELSE 'FALSE' END AS bool_literal,
       CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS bit_literal FROM orders""")
def _(t):
    rows = _orders(t).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("text"),
        F.col("o_totalprice").alias("number"), F.col("o_orderdate").alias("time"),
        (F.col("o_orderstatus") == "P").alias("bool"))
    kind = {f.name: f.dataType for f in rows.schema.fields}

    def literal(name, dialect="postgresql"):
        return text.sql_literal(F.col(name), kind[name], dialect)

    return rows.select(
        "o_orderkey", literal("text").alias("text_literal"), literal("number").alias("number_literal"),
        literal("time").alias("time_literal"), literal("bool").alias("bool_literal"),
        literal("bool", "sqlite").alias("bit_literal"))


@query("h12_csv_cells", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS time_cell,
       CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END AS bool_cell,
       CAST(o_totalprice AS VARCHAR) AS number_cell FROM orders""")
def _(t):
    rows = _orders(t).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("time"),
        (F.col("o_orderstatus") == "P").alias("bool"), F.col("o_totalprice").alias("number"))
    cells = [text.csv_cell(F.col(f.name), f.dataType).alias(f"{f.name}_cell") for f in rows.schema.fields[1:]]
    return rows.select("o_orderkey", *cells)


@query("h13_key_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.tab("documents").select("doc_id", text.key_hash(F.col("text")).alias("hash"))


@query("h14_name_key", r"""
SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || p_brand || ' ', '\s+', ' ', 'g'))) AS name_key
FROM part""")
def _(t):
    shown = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), F.col("p_brand"), F.lit(" "))
    return t.tab("part").select("p_partkey", text.name_key(shown).alias("name_key"))


# In these texts NFKC equals NFC and folding differs from lower() in the sharp s alone.
@query("h14_name_key_documents", r"""
SELECT doc_id, replace(lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))), 'ß', 'ss') AS name_key
FROM documents""")
def _(t):
    return t.tab("documents").select("doc_id", text.name_key(F.col("text")).alias("name_key"))


@query("h15_identifiers", """
SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '_'), '[a-z][a-z0-9_]{0,31}') AS joined_ok,
       regexp_full_match(p_name, '[a-z][a-z0-9_]{0,31}') AS spaced_ok,
       regexp_full_match(p_type, '[a-z][a-z0-9_]{0,31}') AS upper_ok FROM part""")
def _(t):
    return t.tab("part").select(
        "p_partkey",
        text.is_table_name(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("joined_ok"),
        text.is_table_name(F.col("p_name")).alias("spaced_ok"),
        text.is_table_name(F.col("p_type")).alias("upper_ok"))


@query("h16_relabelled_text", """
SELECT doc_id, replace(replace(replace(text, 'entation', '<1>'), 'the', '<2>'), 'an', '<3>') AS text FROM documents""")
def _(t):
    labels = {"an": "<3>", "the": "<2>", "entation": "<1>"}
    return t.tab("documents").select("doc_id", text.relabel(F.col("text"), labels).alias("text"))


@query("h18_percent_of", """
SELECT o_custkey, CAST(floor(count(*) * 12.5 / 100) AS BIGINT) AS n FROM orders GROUP BY o_custkey""")
def _(t):
    return _orders(t).groupBy("o_custkey").agg(draws.percent_of(F.count(F.lit(1)), 12.5).alias("n"))
