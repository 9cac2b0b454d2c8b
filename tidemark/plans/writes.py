"""Generation and write operators (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import batches, bulk, generate, rows, summaries
from tidemark.plans.catalog import (
    CUST, CUST_LATEST, CUSTOMERS, LOG, ORD, ORDERS, ORDERS_CONFIG, RUNS, TS, Roles, customer_values_sql, draw_sql,
    order_values_sql, query, uuid_sql,
)
from tidemark.schema import declare
from tidemark.session import scratch_path

N_ORDERS = "(SELECT count(*) FROM orders)"
N_CUSTOMERS = "(SELECT count(*) FROM customer)"
ORDERS_BASE = "(SELECT max(o_orderkey) + 1 FROM orders)"  # rows and log end at the same version
CUST_BASE = f"greatest({CUST_LATEST}, (SELECT max(version) FROM cust))"
ORDER_COLUMNS = ", ".join(ORDERS.columns)
CUST_COLUMNS = ", ".join(CUSTOMERS.columns)


def _parents_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT customer_id AS parent, row_number() OVER (ORDER BY md5(customer_id)) AS no FROM {source})"


def new_orders_sql(seed, n: str, version: str, index: str = "pidx", row_ts: str = TS) -> str:
    """Generated orders 0..n-1 as a SELECT over ``index``."""
    v = order_values_sql(seed, "i")
    return f"""
    SELECT i, {v['order_id']} AS order_id, parent AS customer_id, {v['amount']} AS amount, {v['status']} AS status,
           {v['priority']} AS priority, {v['urgent']} AS urgent, {v['note']} AS note, {row_ts} AS placed_at,
           {row_ts} AS updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at, {version} AS version
    FROM (SELECT i, {draw_sql(seed, 'orders', 'customer_id', 'i')} % n + 1 AS want
          FROM (SELECT unnest(range({n})) AS i), (SELECT count(*) AS n FROM {index}))
    JOIN {index} ON no = want"""


def new_customers_sql(seed, n: str, version: str) -> str:
    v = customer_values_sql(seed, "i")
    return f"""
    SELECT {v['customer_id']} AS customer_id, {v['name']} AS name, {v['segment']} AS segment,
           {v['balance']} AS balance, CAST(NULL AS TIMESTAMP) AS deleted_at, {version} AS version, i
    FROM (SELECT unnest(range({n})) AS i)"""


def _all_customers(t: Roles):
    return {"customers": (t.customers.select("customer_id"), "customer_id")}


def _live_customers(t: Roles):
    return {"customers": (rows.live_keys(t.customers, "customer_id", "deleted_at"), "customer_id")}


# ------------------------------------------------------------------ generation
@query("i1_generated_orders", f"""
WITH {CUST}, {_parents_sql('pidx', 'cust')}, new AS ({new_orders_sql(21, N_ORDERS, 'CAST(NULL AS BIGINT)')})
SELECT i, {ORDER_COLUMNS} FROM new""")
def _(t):
    return generate.generate(t.spark, ORDERS, t.tab("orders").count(), 21, t.ts, _all_customers(t))


@query("i1_generated_customers", f"""
WITH new AS ({new_customers_sql(21, N_CUSTOMERS, 'CAST(NULL AS BIGINT)')}) SELECT i, {CUST_COLUMNS} FROM new""")
def _(t):
    return generate.generate(t.spark, CUSTOMERS, t.tab("customer").count(), 21, t.ts)


_REWRITTEN = customer_values_sql(21, "customer_id", "customers.update")


@query("i3_updated_values", f"""
WITH {CUST} SELECT customer_id, {_REWRITTEN['name']} AS name, {_REWRITTEN['segment']} AS segment,
       {_REWRITTEN['balance']} AS balance FROM cust""")
def _(t):
    new = generate.updated_values(CUSTOMERS, 21, t.ts)
    return t.customers.select("customer_id", *[value.alias(name) for name, value in new.items()])


@query("i4_row_plan", f"""
WITH {RUNS}, declared AS (SELECT entity, count(*) AS initial_count FROM runs GROUP BY 1),
given AS (SELECT entity, max(rows_inserted) AS n FROM runs WHERE entity IN ('view', 'click') GROUP BY 1)
SELECT entity, coalesce(n, initial_count) AS n FROM declared LEFT JOIN given USING (entity)""")
def _(t):
    declared = t.runs.groupBy("entity").agg(F.count(F.lit(1)).alias("initial_count"))
    given = t.runs.filter(F.col("entity").isin("view", "click")).groupBy("entity").agg(
        F.max("rows_inserted").alias("n"))
    return generate.row_plan(declared, given, None)


# ------------------------------------------------------- append, replace, reset
_APPENDED = f"""{LOG}, {CUST}, new AS ({new_customers_sql(23, N_CUSTOMERS, f'{CUST_BASE} + i + 1')})"""


def _append(t: Roles):
    return batches.append(t.spark, CUSTOMERS, t.customers, t.log, t.tab("customer").count(), 23, t.ts)


@query("i5_append_rows", f"""
WITH {_APPENDED} SELECT {CUST_COLUMNS} FROM cust UNION ALL SELECT {CUST_COLUMNS} FROM new""")
def _(t):
    return _append(t).rows


@query("i5_append_log", f"""
WITH {_APPENDED} SELECT 'customers' AS entity, customer_id AS pk_value, 'insert' AS op, version, {TS} AS changed_at FROM new""")
def _(t):
    return _append(t).log


_REPLACED = f"""{LOG}, {CUST}, base AS (SELECT {CUST_BASE} AS v, (SELECT count(*) FROM cust) AS wiped),
new AS ({new_customers_sql(24, N_CUSTOMERS + ' // 2', '(SELECT v + wiped FROM base) + i + 1')})"""


def _replace(t: Roles):
    return batches.replace(t.spark, CUSTOMERS, t.customers, t.log, t.tab("customer").count() // 2, 24, t.ts)


@query("i6_replace_rows", f"WITH {_REPLACED} SELECT {CUST_COLUMNS} FROM new")
def _(t):
    return _replace(t).rows


@query("i6_replace_log", f"""
WITH {_REPLACED}
SELECT 'customers' AS entity, customer_id AS pk_value, 'delete' AS op,
       (SELECT v FROM base) + row_number() OVER (ORDER BY md5(customer_id)) AS version, {TS} AS changed_at FROM cust
UNION ALL SELECT 'customers', customer_id, 'insert', version, {TS} FROM new""")
def _(t):
    return _replace(t).log


@query("i6_replace_family_log", f"""
WITH {_REPLACED}, {ORD}, {_parents_sql('pidx', 'new')},
kids AS ({new_orders_sql(24, N_ORDERS + ' // 4', f'{ORDERS_BASE} + {N_ORDERS} + i + 1')})
SELECT entity, op, count(*) AS n, min(version) AS first_version, max(version) AS last_version FROM (
  SELECT entity, op, version FROM chg
  UNION ALL SELECT 'customers', 'delete', (SELECT v FROM base) + row_number() OVER (ORDER BY md5(customer_id)) FROM cust
  UNION ALL SELECT 'customers', 'insert', version FROM new
  UNION ALL SELECT 'orders', 'delete', {ORDERS_BASE} + row_number() OVER (ORDER BY md5(order_id)) FROM ord
  UNION ALL SELECT 'orders', 'insert', version FROM kids) GROUP BY 1, 2""")
def _(t):
    """Replacing customers takes the orders along."""
    counts = {"customers": t.tab("customer").count() // 2, "orders": t.tab("orders").count() // 4}
    _, log, _ = batches.run_batch(
        t.spark, {"customers": CUSTOMERS, "orders": ORDERS}, {"customers": t.customers, "orders": t.orders},
        t.log, t.ts, mode="replace", entities=["customers"], counts=counts, seed=24, confirm=True)
    return log.groupBy("entity", "op").agg(
        F.count(F.lit(1)).alias("n"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


@query("i7_reset_log", f"""
WITH {LOG}, {CUST}, {_parents_sql('pidx', 'cust')}, new AS ({new_orders_sql(25, N_ORDERS + ' // 3', 'i + 1')})
SELECT * FROM chg WHERE entity <> 'orders'
UNION ALL SELECT 'orders', order_id, 'insert', version, {TS} FROM new""")
def _(t):
    _, log, _ = batches.run_batch(
        t.spark, {"customers": CUSTOMERS, "orders": ORDERS}, {"customers": t.customers, "orders": t.orders},
        t.log, t.ts, mode="reset", entities=["orders"], counts={"orders": t.tab("orders").count() // 3},
        seed=25, confirm=True)
    return log


@query("i7_reset_rows", f"""
WITH {CUST}, {_parents_sql('pidx', 'cust')}, new AS ({new_orders_sql(25, N_ORDERS + ' // 3', 'i + 1')})
SELECT {ORDER_COLUMNS} FROM new""")
def _(t):
    return batches.reset(t.spark, ORDERS, t.tab("orders").count() // 3, 25, t.ts, _all_customers(t)).rows


# --------------------------------------------------------------- change batches
_V = order_values_sql(31, "o.order_id", "orders.update")
_CHANGED = f"""{LOG}, {CUST}, {ORD}, live AS (SELECT count(*) AS n FROM ord WHERE deleted_at IS NULL),
ranked AS (SELECT order_id, row_number() OVER (ORDER BY md5('31|sample|' || order_id)) AS idx FROM ord WHERE deleted_at IS NULL),
act AS (SELECT order_id, idx, CASE WHEN idx <= n // 5 THEN 'update' ELSE 'delete' END AS action,
               {ORDERS_BASE} + n // 10 + idx AS version FROM ranked, live WHERE idx <= n // 5 + n // 20),
livecust AS (SELECT customer_id FROM cust WHERE deleted_at IS NULL), {_parents_sql('pidx', 'livecust')},
new AS ({new_orders_sql(31, '(SELECT n // 10 FROM live)', f'{ORDERS_BASE} + i + 1')})"""


def _changed(t: Roles):
    n = rows.live_keys(t.orders, "order_id", "deleted_at").count()
    return batches.change_batch(
        t.spark, ORDERS, t.orders, t.log, 31, t.ts, _live_customers(t),
        inserts=n // 10, updates=n // 5, deletes=n // 20)


@query("i8_change_rows", f"""
WITH {_CHANGED}
SELECT o.order_id, o.customer_id,
  CASE WHEN action = 'update' THEN {_V['amount']} ELSE o.amount END AS amount,
  CASE WHEN action = 'update' THEN {_V['status']} ELSE o.status END AS status,
  CASE WHEN action = 'update' THEN {_V['priority']} ELSE o.priority END AS priority,
  CASE WHEN action = 'update' THEN {_V['urgent']} ELSE o.urgent END AS urgent,
  CASE WHEN action = 'update' THEN {_V['note']} ELSE o.note END AS note,
  CASE WHEN action = 'update' THEN {TS} ELSE o.placed_at END AS placed_at,
  CASE WHEN action = 'update' THEN {TS} ELSE o.updated_at END AS updated_at,
  CASE WHEN action = 'delete' THEN {TS} ELSE o.deleted_at END AS deleted_at,
  coalesce(a.version, o.version) AS version
FROM ord o LEFT JOIN act a USING (order_id)
UNION ALL SELECT {ORDER_COLUMNS} FROM new""")
def _(t):
    return _changed(t).rows


@query("i8_change_log", f"""
WITH {_CHANGED}
SELECT 'orders' AS entity, order_id AS pk_value, 'insert' AS op, version, {TS} AS changed_at FROM new
UNION ALL SELECT 'orders', order_id, action, version, {TS} FROM act""")
def _(t):
    return _changed(t).log


_FAMILY = f"""{LOG}, {CUST}, livec AS (SELECT count(*) AS n FROM cust WHERE deleted_at IS NULL),
ranked AS (SELECT customer_id, row_number() OVER (ORDER BY md5('33|sample|' || customer_id)) AS idx FROM cust WHERE deleted_at IS NULL),
newc AS ({new_customers_sql(33, N_CUSTOMERS + ' // 10', '0')}),
now_live AS (SELECT customer_id FROM ranked WHERE NOT (idx > {N_CUSTOMERS} // 20 AND idx <= {N_CUSTOMERS} // 20 * 2)
             UNION ALL SELECT customer_id FROM newc),
{_parents_sql('pidx', 'now_live')},
new AS ({new_orders_sql(33, N_CUSTOMERS + ' // 10', f'{ORDERS_BASE} + i + 1')})"""


@query("i8_family_inserts", f"WITH {_FAMILY} SELECT order_id, customer_id, version FROM new")
def _(t):
    """New orders of a two-table batch point at customers live by then."""
    n = t.tab("customer").count()
    out, _, _, _ = batches.run_changes(
        t.spark, {"customers": CUSTOMERS, "orders": ORDERS}, {"customers": t.customers, "orders": t.orders},
        t.log, t.ts, seed=33, inserts=n // 10, updates=n // 20, deletes=n // 20)
    old = t.tab("orders").select(F.col("o_orderkey").cast("string").alias("order_id"))
    return out["orders"].join(old, "order_id", "left_anti").select("order_id", "customer_id", "version")


@query("i9_tick_sizes", f"""
WITH {ORD}, c AS (SELECT count(*) FILTER (deleted_at IS NULL) AS live_rows, count(*) AS total_rows FROM ord),
u AS (SELECT *, 7 + {draw_sql(41, 'orders', 'tick', '0')} % 18 AS inserts, CAST(floor(live_rows * 4 / 100.0) AS BIGINT) AS updates FROM c)
SELECT *, CAST(floor((live_rows - updates) * 3 / 100.0) AS BIGINT) AS deletes FROM u""")
def _(t):
    sized = batches.tick_sizes(summaries.live_and_total(t.orders, "deleted_at"), ORDERS, 41)
    return sized.select("live_rows", "total_rows", "inserts", "updates", "deletes")


@query("i10_clamped_sizes", f"""
WITH {ORD}, c AS (SELECT count(*) FILTER (deleted_at IS NULL) AS live_rows, count(*) AS total_rows FROM ord)
SELECT live_rows, total_rows, CAST(0 AS BIGINT) AS inserts, total_rows AS updates_asked, live_rows AS updates,
       total_rows AS deletes_asked, CAST(0 AS BIGINT) AS deletes,
       'orders: asked to update ' || total_rows || ' rows, did ' || live_rows AS update_note,
       'orders: asked to delete ' || total_rows || ' rows, did 0' AS delete_note FROM c""")
def _(t):
    n = t.tab("orders").count()
    return batches.tick_sizes(
        summaries.live_and_total(t.orders, "deleted_at"), ORDERS, 41, inserts=0, updates=n, deletes=n)


_TICK = f"""{LOG}, {RUNS}, {CUST}, {ORD}, c AS (SELECT count(*) FILTER (deleted_at IS NULL) AS n FROM ord),
s AS (SELECT 7 + {draw_sql(41, 'orders', 'tick', '0')} % 18 AS i, CAST(floor(n * 4 / 100.0) AS BIGINT) AS u,
             CAST(floor((n - CAST(floor(n * 4 / 100.0) AS BIGINT)) * 3 / 100.0) AS BIGINT) AS d FROM c),
ranked AS (SELECT order_id, row_number() OVER (ORDER BY md5('41|sample|' || order_id)) AS idx FROM ord WHERE deleted_at IS NULL),
{_parents_sql('pidx', 'cust')}, new AS ({new_orders_sql(41, '(SELECT i FROM s)', f'{ORDERS_BASE} + i + 1')})"""


def _tick(t: Roles):
    return batches.tick(t.spark, ORDERS, t.orders, t.log, 41, t.ts, _all_customers(t))


@query("i11_tick_log", f"""
WITH {_TICK}
SELECT 'orders' AS entity, order_id AS pk_value, 'insert' AS op, version, {TS} AS changed_at FROM new
UNION ALL SELECT 'orders', order_id, CASE WHEN idx <= u THEN 'update' ELSE 'delete' END, {ORDERS_BASE} + i + idx, {TS}
FROM ranked, s WHERE idx <= u + d""")
def _(t):
    return _tick(t).log


@query("i11_tick_record", f"""
WITH {_TICK} SELECT (SELECT max(run_id) + 1 FROM runs) AS run_id, 'orders' AS entity, {TS} AS started_at,
  {TS} AS finished_at, i AS rows_inserted, u AS rows_mutated, d AS rows_deleted, 'success' AS status FROM s""")
def _(t):
    """The record is made after the batch has been stored."""
    def write():
        made = _tick(t)
        made.rows.write.parquet(scratch_path(t.spark, "tick-rows"))
        made.log.write.parquet(scratch_path(t.spark, "tick-log"))
        return made.stats

    return batches.recorded(t.spark, t.runs, "orders", t.ts, write)


@query("i11_failed_tick_record", f"""
WITH {RUNS} SELECT (SELECT max(run_id) + 1 FROM runs) AS run_id, 'orders' AS entity, {TS} AS started_at,
  {TS} AS finished_at, CAST(0 AS BIGINT) AS rows_inserted, CAST(0 AS BIGINT) AS rows_mutated, CAST(0 AS BIGINT) AS rows_deleted, 'failed' AS status""")
def _(t):
    """A tick whose rows cannot be stored: the folder is taken."""
    path = scratch_path(t.spark, "taken")
    t.runs.limit(1).write.parquet(path)

    def write():
        made = _tick(t)
        made.rows.write.parquet(path)
        return made.stats

    return batches.recorded(t.spark, t.runs, "orders", t.ts, write)


@query("i12_reproducible", f"SELECT {N_ORDERS} AS n_rows, CAST(0 AS BIGINT) AS n_different")
def _(t):
    """The same seed on 3 and on 13 partitions."""
    n = t.tab("orders").count()

    def made(parts):
        numbers = t.spark.range(0, n, 1, parts).withColumnRenamed("id", "i")
        return generate.generate(t.spark, ORDERS, n, 21, t.ts, _all_customers(t), numbers=numbers)

    side = F.struct(*[F.col(c) for c in ORDERS.columns])
    one, two = made(3).select("i", side.alias("a")), made(13).select("i", side.alias("b"))
    return one.join(two, "i", "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


@query("i13_headroom", f"""
WITH {RUNS}, c AS (SELECT entity, count(*) AS total_rows, max(rows_inserted) AS asked FROM runs GROUP BY 1)
SELECT *, least(asked, greatest(0, 2000 - total_rows)) AS allowed, asked > greatest(0, 2000 - total_rows) AS over_cap FROM c""")
def _(t):
    counts = t.runs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total_rows"), F.max("rows_inserted").alias("asked"))
    return batches.headroom(counts, 2000, F.col("asked"))


@query("i14_collisions", f"""
SELECT {uuid_sql(23, 'customers', 'customer_id', 'i')} AS customer_id FROM (SELECT unnest(range({N_CUSTOMERS})) AS i)""")
def _(t):
    """Reusing the seed of an earlier append for twice as many rows."""
    n = t.tab("customer").count()
    held = batches.append(t.spark, CUSTOMERS, t.customers, t.log, n, 23, t.ts, check=False).rows
    return generate.existing_keys(generate.new_keys(t.spark, CUSTOMERS, 2 * n, 23), held, "customer_id")


@query("i15_missing_parents", f"""
SELECT 'all customers' AS parents, NULL AS error, {N_ORDERS} AS n_children
UNION ALL SELECT 'no customers', 'missing_parent_rows', {N_ORDERS}""")
def _(t):
    children = t.tab("orders").select("o_orderkey")
    found = []
    for label, keys in (("all customers", t.customers), ("no customers", t.customers.filter("balance < -1000000"))):
        try:
            generate.assign_parents(children, keys, "customer_id", "customer_id", F.col("o_orderkey"))
            found.append((label, None, children.count()))
        except generate.MissingParents as exc:
            found.append((label, str(exc).split(":")[0], children.count()))
    return t.spark.createDataFrame(found, "parents string, error string, n_children bigint")


@query("i16_seeded_if_empty", f"""
WITH {CUST}, {_parents_sql('pidx', 'cust')}, new AS ({new_orders_sql(51, N_ORDERS, 'i + 1')}) SELECT {ORDER_COLUMNS} FROM new""")
def _(t):
    """Customers are there and stay; orders are empty and get their declared number of rows."""
    declared = declare(ORDERS_CONFIG | {"seed": {"initial_count": t.tab("orders").count()}}, siblings=["customers"])
    data = {"customers": t.customers, "orders": t.orders.filter("order_id IS NULL")}
    return generate.seed_missing(
        t.spark, {"customers": CUSTOMERS, "orders": declared}, data, 51, t.ts)["orders"]


# ----------------------------------------------------------------- bulk payloads
# Positions with gaps, as row ids of a distributed job have them.
_CREATED = f"""{LOG}, {CUST}, {ORD}, {_parents_sql('pidx', 'cust')},
gen AS ({new_orders_sql(61, N_ORDERS, f'{ORDERS_BASE} + i + 1')}),
given AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, c.customer_id AS cid, o_totalprice, o_orderstatus
          FROM orders LEFT JOIN cust c ON c.customer_id = CAST(o_custkey AS VARCHAR) AND o_orderpriority <> '1-URGENT')"""


def _payloads(t: Roles):
    """One partial order per given order: its price always, its customer unless urgent, a null
    note for finished ones."""
    text = F.concat(
        F.lit('{"amount": '), F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit(', "customer_id": "'), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("o_orderstatus") == "F", ', "note": null').otherwise(""), F.lit("}"))
    return t.tab("orders").select((F.col("o_orderkey") * 7 + 3).alias("row_pos"), text.alias("payload"))


def _created(t: Roles):
    return bulk.create_rows(t.spark, ORDERS, t.orders, t.log, _payloads(t), 61, t.ts, _all_customers(t))


@query("i17_bulk_created", f"""
WITH {_CREATED}
SELECT {ORDER_COLUMNS} FROM ord UNION ALL
SELECT order_id, coalesce(cid, customer_id), o_totalprice, status, priority, urgent,
       CASE WHEN o_orderstatus <> 'F' THEN note END, placed_at, updated_at, deleted_at, version
FROM gen JOIN given USING (i)""")
def _(t):
    return _created(t).rows


@query("i17_bulk_created_log", f"""
WITH {_CREATED} SELECT 'orders' AS entity, order_id AS pk_value, 'insert' AS op, version, {TS} AS changed_at FROM gen""")
def _(t):
    return _created(t).log


@query("i17_repeated_position", f"""
SELECT 'repeated_position' AS error, {N_ORDERS} + 1 AS n_payloads""")
def _(t):
    """One position given twice: the whole batch is refused."""
    twice = _payloads(t).unionByName(_payloads(t).orderBy("row_pos").limit(1))
    try:
        bulk.create_rows(t.spark, ORDERS, t.orders, t.log, twice, 61, t.ts, _all_customers(t))
        error = None
    except bulk.InvalidBatch as exc:
        error = str(exc).split(":")[0]
    return t.spark.createDataFrame([(error, twice.count())], "error string, n_payloads bigint")


@query("i13_capped_writes", f"""
WITH {ORD}, c AS (SELECT count(*) AS n FROM ord)
SELECT 'append over the cap' AS request, 'quota_exceeded' AS error, CAST(NULL AS BIGINT) AS inserted FROM c
UNION ALL SELECT 'append up to the cap', NULL, 4 FROM c
UNION ALL SELECT 'change batch over the cap', 'quota_exceeded', NULL FROM c
UNION ALL SELECT 'default change batch', NULL, 4 FROM c""")
def _(t):
    """A cap with room for four more orders."""
    capped = {"customers": CUSTOMERS, "orders": declare(ORDERS_CONFIG, siblings=["customers"], max_rows=t.orders.count() + 4)}
    data = {"customers": t.customers, "orders": t.orders}

    def outcome(write):
        try:
            stats = write()
            return None, [s["inserted"] for s in stats if s["entity"] == "orders"][0]
        except ValueError as exc:
            return str(exc).split(":")[0], None

    append = lambda n: lambda: batches.run_batch(t.spark, capped, data, t.log, t.ts, entities=["orders"], count=n, seed=71)[2]
    change = lambda n: lambda: batches.run_changes(t.spark, capped, data, t.log, t.ts, entities=["orders"], inserts=n, updates=0, deletes=0, seed=72)[2]
    found = [("append over the cap", *outcome(append(5))), ("append up to the cap", *outcome(append(4))),
             ("change batch over the cap", *outcome(change(5))), ("default change batch", *outcome(change(None)))]
    return t.spark.createDataFrame(found, "request string, error string, inserted bigint")


@query("i7_reset_runs", f"WITH {RUNS} SELECT * FROM runs WHERE entity NOT IN ('view', 'click')")
def _(t):
    """A reset ends the run history of its tables with their log."""
    return batches.forget(t.runs, ["view", "click"])


_REQUESTS = """req AS (
  SELECT event_id AS row_pos, CAST(user_id * 3 AS VARCHAR) AS key, event_type, value, ts,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
good AS (
  SELECT r.*, row_number() OVER (ORDER BY row_pos) AS idx FROM req r
  JOIN ord o ON o.order_id = r.key WHERE o.deleted_at IS NULL AND event_type <> 'error')"""


def _requests(t: Roles):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    stamp = F.date_trunc("second", "ts").cast("timestamp_ntz").cast("string")
    text = (
        F.when(kind == "signup", F.concat(F.lit('{"amount": '), value, F.lit("}")))
        .when(kind == "view", F.lit('{"status": "O", "note": null}'))
        .when(kind == "click", F.concat(F.lit('{"priority": '), F.get_json_object("props", "$.k"), F.lit("}")))
        .when(kind == "error", F.lit('{"bogus": 1}'))
        .otherwise(F.concat(F.lit('{"urgent": true, "placed_at": "'), stamp, F.lit('"}'))))
    return t.tab("events").select(
        F.col("event_id").alias("row_pos"), (F.col("user_id") * 3).cast("string").alias("key"),
        text.alias("payload"))


def _updated(t: Roles):
    return bulk.update_rows(ORDERS, t.orders, t.log, _requests(t), t.ts, _all_customers(t))


@query("i18_bulk_updated", f"""
WITH {ORD}, {_REQUESTS}, last AS (
  SELECT key, max(idx) AS idx, arg_max(value, row_pos) FILTER (event_type = 'signup') AS amount,
         bool_or(event_type = 'view') AS viewed, arg_max(k, row_pos) FILTER (event_type = 'click') AS priority,
         arg_max(date_trunc('second', ts), row_pos) FILTER (event_type = 'purchase') AS placed_at
  FROM good GROUP BY key)
SELECT order_id, customer_id, coalesce(l.amount, o.amount) AS amount,
       CASE WHEN viewed THEN 'O' ELSE o.status END AS status, coalesce(l.priority, o.priority) AS priority,
       urgent OR l.placed_at IS NOT NULL AS urgent, CASE WHEN viewed IS NOT TRUE THEN note END AS note,
       coalesce(l.placed_at, o.placed_at) AS placed_at,
       CASE WHEN idx IS NOT NULL THEN {TS} ELSE o.updated_at END AS updated_at, deleted_at,
       coalesce({ORDERS_BASE} + idx, version) AS version
FROM ord o LEFT JOIN last l ON l.key = o.order_id""")
def _(t):
    return _updated(t)[0].rows


@query("i18_bulk_update_log", f"""
WITH {ORD}, {_REQUESTS}
SELECT 'orders' AS entity, key AS pk_value, 'update' AS op, {ORDERS_BASE} + idx AS version, {TS} AS changed_at FROM good""")
def _(t):
    return _updated(t)[0].log


@query("i18_bulk_update_outcomes", f"""
WITH {ORD}, {_REQUESTS}
SELECT row_pos, r.key, CASE WHEN o.order_id IS NULL THEN 'not_found'
         WHEN event_type = 'error' THEN 'unknown_field' END AS error_code
FROM req r LEFT JOIN ord o ON o.order_id = r.key AND o.deleted_at IS NULL""")
def _(t):
    return _updated(t)[1].select("row_pos", "key", "error_code")


def _refusal(t: Roles, requests, write):
    """The code a bulk request is refused with, and its size."""
    try:
        write(requests)
        error = None
    except bulk.InvalidBatch as exc:
        error = str(exc).split(":")[0]
    return t.spark.createDataFrame([(error, requests.count())], "error string, n_requests bigint")


@query("i18_repeated_position", "SELECT 'repeated_position' AS error, count(*) + 1 AS n_requests FROM events")
def _(t):
    """One update's position given twice: which one is last is not defined, so the whole request is refused."""
    requests = _requests(t)
    twice = requests.unionByName(requests.orderBy("row_pos").limit(1))
    return _refusal(t, twice, lambda r: bulk.update_rows(ORDERS, t.orders, t.log, r, t.ts, _all_customers(t)))


_GONE = f"""{LOG}, {CUST}, req AS (SELECT event_id AS row_pos, CAST(user_id AS VARCHAR) AS key FROM events),
good AS (SELECT row_pos, key, {CUST_BASE} + row_number() OVER (ORDER BY row_pos) AS version
         FROM req JOIN cust ON customer_id = key)"""


def _deleted(t: Roles):
    wanted = t.tab("events").select(
        F.col("event_id").alias("row_pos"), F.col("user_id").cast("string").alias("key"))
    return bulk.delete_rows(CUSTOMERS, t.customers, t.log, wanted, t.ts)


@query("i19_bulk_deleted", f"""
WITH {_GONE}, last AS (SELECT key, max(version) AS v FROM good GROUP BY 1)
SELECT customer_id, name, segment, balance, CASE WHEN v IS NOT NULL THEN {TS} ELSE deleted_at END AS deleted_at,
       coalesce(v, version) AS version FROM cust LEFT JOIN last ON key = customer_id""")
def _(t):
    return _deleted(t)[0].rows


@query("i19_bulk_delete_log", f"""
WITH {_GONE} SELECT 'customers' AS entity, key AS pk_value, 'delete' AS op, version, {TS} AS changed_at FROM good""")
def _(t):
    return _deleted(t)[0].log


@query("i19_bulk_delete_outcomes", f"""
WITH {_GONE} SELECT row_pos, key, CASE WHEN customer_id IS NULL THEN 'not_found' END AS error_code
FROM req LEFT JOIN cust ON customer_id = key""")
def _(t):
    return _deleted(t)[1]


@query("i19_null_position", "SELECT 'missing_position' AS error, count(*) AS n_requests FROM events")
def _(t):
    """A delete without a position: the whole request is refused."""
    wanted = t.tab("events").select(
        F.expr("nullif(event_id, 0)").alias("row_pos"), F.col("user_id").cast("string").alias("key"))
    return _refusal(t, wanted, lambda r: bulk.delete_rows(CUSTOMERS, t.customers, t.log, r, t.ts))
