"""Change feed, row filters, joins and replay (A2, A3, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions.draws import draw
from tidemark.operators import feed, generate, ranking, rows, tenancy, validation
from tidemark.operators.skew import join_unique
from tidemark.plans.catalog import (
    CONFIGS, CUST, CUST_LATEST, CUSTOMERS, KEYS, LOG, ORD, ORDERS, PROJECTS, PROVIDERS, SOLVENT, Roles, draw_sql, query,
)
from tidemark.sources.tables import scan, snapshot

_CUST_VALUES = "c.name, c.segment, c.balance, c.deleted_at"


def _latest(t: Roles) -> int:
    return feed.entity_latest(t.log, "customers")


# ------------------------------------------------------------------------ scans
@query("a1_declared_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    declared = StructType([
        StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
        StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType())])
    return scan(t.spark, f"{t.sf_dir}/orders.parquet", declared)


@query("a2_snapshot", f"WITH {ORD} SELECT * FROM ord WHERE deleted_at IS NULL")
def _(t):
    return snapshot(t.orders, ORDERS, ordered=True)


@query("a2_snapshot_with_deleted", f"WITH {ORD} SELECT * FROM ord")
def _(t):
    return snapshot(t.orders, ORDERS, include_deleted=True)


@query("a3_delta", f"""
WITH {LOG}, {CUST}
SELECT l.op, l.pk_value AS customer_id, {_CUST_VALUES}, l.version
FROM chg l LEFT JOIN cust c ON c.customer_id = l.pk_value
WHERE l.entity = 'customers' AND l.version > {CUST_LATEST} // 4 AND l.version <= {CUST_LATEST} // 4 * 3""")
def _(t):
    quarter = _latest(t) // 4
    return feed.delta(t.log, t.customers, "customers", "customer_id", quarter, quarter * 3).orderBy("version")


# ------------------------------------------------------------ filters, lookups
@query("b1_live_rows", f"WITH {CUST} SELECT * FROM cust WHERE deleted_at IS NULL")
def _(t):
    return rows.live(t.customers, "deleted_at")


@query("b2_key_lookup", f"""
WITH {SOLVENT} SELECT event_id, CAST(user_id AS VARCHAR) AS wanted,
  CASE WHEN c.customer_id IS NULL THEN 'missing' WHEN c.deleted_at IS NOT NULL THEN 'deleted' ELSE 'found' END AS status
FROM events LEFT JOIN cust c ON c.customer_id = CAST(user_id AS VARCHAR)""")
def _(t):
    wanted = t.tab("events").select("event_id", F.col("user_id").cast("string").alias("wanted"))
    return rows.lookup(wanted, "wanted", t.solvent, "customer_id", "deleted_at")


@query("b3_keyset_seek", f"WITH {ORD} SELECT * FROM ord WHERE deleted_at IS NULL AND order_id > '42'")
def _(t):
    return rows.live(t.orders.filter(F.col("order_id") > "42"), "deleted_at")


@query("b4_version_range", f"""
WITH {LOG} SELECT * FROM chg WHERE entity = 'customers'
  AND version > {CUST_LATEST} // 3 AND version <= {CUST_LATEST} // 3 * 2""")
def _(t):
    third = _latest(t) // 3
    return feed.between(t.log, "customers", third, third * 2)


@query("b5_delta_projection", f"""
WITH {LOG}, {ORD}
SELECT l.op, o.order_id, o.customer_id, o.amount, o.status, o.priority, o.urgent, o.note, o.placed_at,
       o.updated_at, o.deleted_at, l.version
FROM chg l JOIN ord o ON o.order_id = l.pk_value WHERE l.entity = 'orders'""")
def _(t):
    changes = feed.enrich(t.log.filter("entity = 'orders'"), t.orders, "order_id")
    return changes.select("op", *ORDERS.columns)


@query("b6_active_credentials", f"""
WITH {KEYS}, {PROVIDERS} SELECT k.id AS key_id, key_hash, provider_id, full_name
FROM keys k JOIN prov p ON p.id = k.provider_id WHERE revoked_at IS NULL AND is_active""")
def _(t):
    return tenancy.active_credentials(t.keys, t.providers)


@query("b7_keys", f"WITH {ORD} SELECT order_id FROM ord")
def _(t):
    return t.orders.select(ORDERS.pk)


@query("b8_live_keys", f"WITH {ORD} SELECT order_id FROM ord WHERE deleted_at IS NULL")
def _(t):
    return rows.live_keys(t.orders, ORDERS.pk, ORDERS.soft_delete)


# -------------------------------------------------------------------- versions
@query("c1_latest_versions", f"""
WITH {LOG}, ent AS (SELECT DISTINCT entity FROM chg UNION ALL SELECT 'tickets')
SELECT e.entity, coalesce(max(version), 0) AS latest_version FROM ent e LEFT JOIN chg USING (entity) GROUP BY 1""")
def _(t):
    named = t.log.select("entity").distinct().unionByName(
        t.spark.range(1).select(F.lit("tickets").alias("entity")))
    return feed.latest_versions(t.log, named)


@query("c2_next_versions", f"""
WITH {LOG}, {CUST}, {ORD}, used AS (
  SELECT entity, version FROM chg UNION ALL SELECT 'customers', version FROM cust
  UNION ALL SELECT 'orders', version FROM ord)
SELECT entity, max(version) + 1 AS next_version FROM used GROUP BY entity""")
def _(t):
    held = t.customers.select(F.lit("customers").alias("entity"), "version").unionByName(
        t.orders.select(F.lit("orders").alias("entity"), "version"))
    return feed.next_versions(held, t.log)


# ----------------------------------------------------------------------- pages
@query("c3_feed_page", f"""
WITH {LOG} SELECT * FROM chg WHERE entity = 'customers' AND version > {CUST_LATEST} // 2
ORDER BY version LIMIT 500""")
def _(t):
    return feed.feed_page(t.log, "customers", _latest(t) // 2, 500)


@query("c4_page_facts", f"""
WITH {LOG}, page AS (
  SELECT * FROM chg WHERE entity = 'customers' AND version > {CUST_LATEST} // 2 ORDER BY version LIMIT 500)
SELECT 'customers' AS entity, coalesce(max(version), {CUST_LATEST} // 2) AS next_cursor,
       {CUST_LATEST} AS latest_version, count(*) = 500 AS has_more FROM page""")
def _(t):
    return feed.page_facts(t.log, "customers", _latest(t) // 2, 500)


@query("c4_empty_page_facts", f"""
SELECT 'orders' AS entity, max(o_orderkey) + 1 AS next_cursor, max(o_orderkey) + 1 AS latest_version,
       FALSE AS has_more FROM orders""")
def _(t):
    return feed.page_facts(t.log, "orders", feed.entity_latest(t.log, "orders"), 500)


@query("c5_enriched_feed", f"""
WITH {LOG}, {SOLVENT}
SELECT l.op, l.pk_value AS customer_id, {_CUST_VALUES}, l.version
FROM chg l LEFT JOIN cust c ON c.customer_id = l.pk_value WHERE l.entity = 'customers'""")
def _(t):
    return feed.enrich(t.log.filter("entity = 'customers'"), t.solvent, "customer_id")


@query("c6_cursor_status", f"""
WITH {LOG}, cur AS (
  SELECT c_name AS consumer, CASE WHEN c_nationkey < 12 THEN 'customers' ELSE 'orders' END AS entity,
         c_custkey * 12 AS since FROM customer),
latest AS (SELECT entity, max(version) AS v FROM chg GROUP BY 1)
SELECT consumer, entity, since, v AS latest_version,
       CASE WHEN since > v THEN 'cursor_ahead_of_source' ELSE 'ok' END AS status,
       CASE WHEN since <= v THEN v - since END AS lag
FROM cur JOIN latest USING (entity)""")
def _(t):
    cursors = t.tab("customer").select(
        F.col("c_name").alias("consumer"),
        F.when(F.col("c_nationkey") < 12, "customers").otherwise("orders").alias("entity"),
        (F.col("c_custkey") * 12).alias("since"))
    return feed.cursor_status(cursors, t.log)


@query("c7_drained_pages", f"""
WITH {LOG}, numbered AS (
  SELECT entity, version, (row_number() OVER (PARTITION BY entity ORDER BY version) - 1) // 100 AS page FROM chg)
SELECT entity, page, min(version) AS first_version, max(version) AS next_cursor, count(*) AS n_changes,
       count(*) = 100 AS has_more FROM numbered GROUP BY entity, page""")
def _(t):
    return feed.drain(t.log, 100)


# ---------------------------------------------------------------------- replay
@query("c8_replayed_customers", f"""
WITH {LOG}, {SOLVENT}, delta AS (
  SELECT * FROM chg WHERE entity = 'customers' AND version > {CUST_LATEST} // 2),
last AS (SELECT pk_value, arg_max(op, version) AS op, max(version) AS version FROM delta GROUP BY 1),
snap AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, c_mktsegment AS segment,
         CAST(0 AS DOUBLE) AS balance, CAST(NULL AS TIMESTAMP) AS deleted_at, c_custkey + 1 AS version FROM customer)
SELECT coalesce(s.customer_id, l.pk_value) AS customer_id,
       CASE WHEN l.op IS NULL THEN s.name ELSE c.name END AS name,
       CASE WHEN l.op IS NULL THEN s.segment ELSE c.segment END AS segment,
       CASE WHEN l.op IS NULL THEN s.balance ELSE c.balance END AS balance,
       CASE WHEN l.op IS NULL THEN s.deleted_at ELSE c.deleted_at END AS deleted_at,
       coalesce(l.version, s.version) AS version
FROM snap s FULL JOIN last l ON l.pk_value = s.customer_id LEFT JOIN cust c ON c.customer_id = l.pk_value
WHERE l.op IS NULL OR l.op <> 'delete'""")
def _(t):
    """A consumer's old copy (balances still 0) caught up with the second half of the log."""
    latest = _latest(t)
    copy = t.tab("customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.lit(0.0).alias("balance"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"), (F.col("c_custkey") + 1).alias("version"))
    changes = feed.delta(t.log, t.solvent, "customers", "customer_id", latest // 2, latest)
    return feed.replay(copy, changes, CUSTOMERS.pk)


@query("c8_last_change", f"""
WITH {LOG} SELECT entity, pk_value, max(version) AS version, arg_max(op, version) AS op FROM chg GROUP BY 1, 2""")
def _(t):
    return feed.last_change(t.log, "entity", "pk_value")


# ----------------------------------------------------------------------- joins
@query("c9_attributed_requests", f"""
WITH {KEYS}, {PROVIDERS}, good AS (
  SELECT k.id AS key_id, key_hash, provider_id, full_name FROM keys k JOIN prov p ON p.id = k.provider_id
  WHERE revoked_at IS NULL AND is_active)
SELECT event_id, 'secret-' || user_id AS secret, key_id, provider_id, full_name
FROM events LEFT JOIN good ON key_hash = sha256('secret-' || user_id)""")
def _(t):
    requests = t.tab("events").select(
        "event_id", F.concat(F.lit("secret-"), F.col("user_id").cast("string")).alias("secret"))
    return tenancy.attribute(requests, "secret", t.keys, t.providers)


@query("c8_older_delta", f"WITH {CUST} SELECT * FROM cust")
def _(t):
    """A delta from before the snapshot, with other values: the snapshot stays as it is."""
    older = t.customers.select(
        F.lit("update").alias("op"), "customer_id", F.lit("stale").alias("name"), "segment", "balance", "deleted_at",
        (F.col("version") - 1).alias("version"))
    return feed.replay(t.customers, older, "customer_id")


@query("c10_dangling_orders", f"""
WITH {SOLVENT}, {ORD} SELECT order_id, customer_id FROM ord o
WHERE NOT EXISTS (SELECT 1 FROM cust c WHERE c.customer_id = o.customer_id)""")
def _(t):
    return validation.dangling_refs(t.orders.select("order_id", "customer_id"), "customer_id", t.solvent, "customer_id")


@query("c11_assigned_parents", f"""
WITH {CUST}, live AS (SELECT customer_id FROM cust WHERE deleted_at IS NULL),
idx AS (SELECT customer_id, row_number() OVER (ORDER BY md5(customer_id)) AS no FROM live)
SELECT o_orderkey, customer_id
FROM (SELECT o_orderkey, {draw_sql(11, 'orders', 'customer_id', 'o_orderkey')} % n + 1 AS want
      FROM orders, (SELECT count(*) AS n FROM live))
JOIN idx ON no = want""")
def _(t):
    children = t.tab("orders").select("o_orderkey")
    keys = rows.live_keys(t.customers, "customer_id", "deleted_at")
    return generate.assign_parents(
        children, keys, "customer_id", "customer_id", draw(11, "orders", "customer_id", F.col("o_orderkey")))


@query("c12_owner_names", f"""
WITH {CONFIGS}, {PROJECTS}, {PROVIDERS}
SELECT c.id, c.name, c.provider_id, c.project_id, p.name AS project_name, p.is_only_me AS project_private,
       v.full_name AS owner_name
FROM conf c LEFT JOIN proj p ON p.id = c.project_id LEFT JOIN prov v ON v.id = c.provider_id""")
def _(t):
    named = tenancy.with_names(
        t.configs.select("id", "name", "provider_id", "project_id"), "project_id", t.projects, "id",
        project_name="name", project_private="is_only_me")
    return tenancy.with_names(named, "provider_id", t.providers, "id", owner_name="full_name")


@query("c13_bulk_lookup", f"""
WITH {ORD} SELECT event_id, order_id, amount, status FROM events LEFT JOIN ord ON order_id = CAST(event_id * 2 AS VARCHAR)""")
def _(t):
    wanted = t.tab("events").select("event_id", (F.col("event_id") * 2).cast("string").alias("_wanted"))
    found = t.orders.select("order_id", "amount", "status")
    return join_unique(wanted, found, "_wanted", "order_id").drop("_wanted")


# -------------------------------------------------------------- dense versions
@query("e1_dense_versions", f"""
WITH {LOG} SELECT entity, version, row_number() OVER (PARTITION BY entity ORDER BY version) AS idx
FROM chg WHERE op <> 'update'""")
def _(t):
    kept = t.log.filter("op <> 'update'").select("entity", "version")
    return ranking.index_by_integer(kept, "version", by=["entity"], bits=10)


@query("e1_dense_by_digest", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS idx FROM orders")
def _(t):
    tagged = t.tab("orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("_digest"))
    return ranking.index_by_digest(tagged, "_digest").drop("_digest")


@query("e1_dense_by_any_order", """
SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS idx FROM orders""")
def _(t):
    return ranking.index_sorted(t.tab("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("e4_chunks", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk,
       CAST(ceil(count(*) OVER () / 1000.0) AS BIGINT) AS n_chunks FROM orders""")
def _(t):
    keys = t.tab("orders").select("o_orderkey")
    total = keys.agg(ranking.chunk_count(F.count(F.lit(1)), 1000).alias("n_chunks"))
    chunks = ranking.chunked(ranking.index_by_integer(keys, "o_orderkey"), 1000).drop("idx")
    return chunks.withColumn("n_chunks", F.lit(total.first()[0]).cast("bigint"))
