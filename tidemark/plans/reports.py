"""Counts, rankings, pages, samples (D, E, F) and registry reports (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import ascii_name_key, name_key
from tidemark.operators import ranking, rows, summaries, tenancy
from tidemark.plans.catalog import (
    CONFIGS, CUST, KEYS, LOG, ORD, ORDERS, PROJECTS, PROVIDERS, RUNS, Roles, query,
)


def _entity_rows(t: Roles):
    return t.customers.select(F.lit("customers").alias("entity")).unionByName(
        t.orders.select(F.lit("orders").alias("entity")))


# ---------------------------------------------------------------------- counts
@query("d1_row_counts", f"""
WITH {CUST}, {ORD} SELECT 'customers' AS entity, count(*) AS row_count FROM cust
UNION ALL SELECT 'orders', count(*) FROM ord""")
def _(t):
    return summaries.row_counts(_entity_rows(t), "entity")


@query("d2_live_and_total", f"""
WITH {ORD} SELECT count(*) FILTER (deleted_at IS NULL) AS live_rows, count(*) AS total_rows FROM ord""")
def _(t):
    return summaries.live_and_total(t.orders, "deleted_at")


@query("d3_owned_counts", f"""
WITH {PROVIDERS}, {PROJECTS}, {CONFIGS}
SELECT id, full_name, (SELECT count(*) FROM proj j WHERE j.provider_id = p.id) AS project_count,
       (SELECT count(*) FROM conf c WHERE c.provider_id = p.id) AS config_count FROM prov p""")
def _(t):
    return summaries.owned_counts(
        t.providers.select("id", "full_name"), "id",
        project_count=(t.projects, "provider_id"), config_count=(t.configs, "provider_id"))


@query("d4_op_tallies", f"""
WITH {LOG} SELECT entity, count(*) FILTER (op = 'insert') AS inserted, count(*) FILTER (op = 'update') AS updated,
       count(*) FILTER (op = 'delete') AS deleted, min(version) AS first_version, max(version) AS last_version
FROM chg GROUP BY entity""")
def _(t):
    return summaries.op_tallies(t.log)


@query("d5_quota_usage", f"""
WITH {PROJECTS}, {PROVIDERS}, used AS (
  SELECT p.id AS provider_id, count(j.id) AS used FROM prov p LEFT JOIN proj j ON j.provider_id = p.id AND j.source = 'api' GROUP BY 1)
SELECT provider_id, used, greatest(0, 3 - used) AS remaining,
       CASE WHEN used >= 3 THEN 'quota_exceeded' ELSE 'ok' END AS status FROM used""")
def _(t):
    return summaries.quota_usage(t.providers, "id", t.projects, "provider_id", F.col("source") == "api", 3)


@query("d6_privacy_fold", f"""
WITH {CONFIGS} SELECT project_id, bool_or(is_only_me) AS is_private,
       bool_or(is_only_me) AND NOT bool_and(is_only_me) AS is_mixed,
       count(*) FILTER (is_only_me) AS n_private, count(*) AS n_members FROM conf GROUP BY 1""")
def _(t):
    return summaries.privacy_fold(t.configs, "project_id", F.col("is_only_me"))


@query("d7_listed_keys", f"""
WITH {KEYS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY created_seq) AS idx FROM keys)
SELECT provider_id, (idx - 1) // 20 AS list_no, string_agg(id, ',' ORDER BY idx) AS items FROM n GROUP BY 1, 2""")
def _(t):
    lists = summaries.listed(t.keys, "provider_id", "id", "created_seq", size=20)
    return lists.withColumn("items", F.array_join("items", ","))


# --------------------------------------------------------------------- ranking
@query("e2_last_runs", f"""
WITH {RUNS}, ent AS (SELECT DISTINCT entity FROM runs UNION ALL SELECT 'refund')
SELECT e.entity, arg_max(finished_at, run_id) AS last_run, arg_max(status, run_id) AS last_status
FROM ent e LEFT JOIN runs USING (entity) GROUP BY 1""")
def _(t):
    named = t.runs.select("entity").distinct().unionByName(t.spark.range(1).select(F.lit("refund").alias("entity")))
    return tenancy.last_runs(named, t.runs)


@query("e3_first_name_wins", """
SELECT p_partkey, p_name, CASE WHEN row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1
       THEN lower(p_name) END AS name_key FROM part""")
def _(t):
    keyed = t.tab("part").select("p_partkey", "p_name", ascii_name_key(F.col("p_name")).alias("_key"))
    return ranking.keep_first(keyed, "_key", "p_partkey", "name_key").drop("_key")


# --------------------------------------------------------------- pages, samples
@query("f1_keyset_page", f"""
WITH {ORD} SELECT * FROM ord WHERE deleted_at IS NULL AND order_id > '42' ORDER BY order_id LIMIT 20""")
def _(t):
    return rows.page(t.orders, ORDERS.pk, ORDERS.soft_delete, 20, after="42")


@query("f1_page_end", f"""
WITH {ORD}, page AS (SELECT * FROM ord WHERE deleted_at IS NULL AND order_id > '42' ORDER BY order_id LIMIT 20)
SELECT count(*) AS n_rows, CASE WHEN count(*) = 20 THEN max(order_id) END AS next_after FROM page""")
def _(t):
    return rows.page_end(rows.page(t.orders, ORDERS.pk, ORDERS.soft_delete, 20, after="42"), ORDERS.pk, 20)


@query("f2_page_directory", f"""
WITH {ORD}, n AS (SELECT order_id, (row_number() OVER (ORDER BY order_id) - 1) // 50 AS page FROM ord WHERE deleted_at IS NULL)
SELECT page, min(order_id) AS first_key, max(order_id) AS last_key, count(*) AS n_rows FROM n GROUP BY page""")
def _(t):
    return rows.page_directory(t.orders, ORDERS.pk, ORDERS.soft_delete, 50)


@query("f3_recent_runs", f"""
WITH {RUNS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY run_id DESC) AS rank FROM runs)
WHERE rank <= 20""")
def _(t):
    return rows.latest_per_group(t.runs, "entity", "run_id", 20)


@query("f3_recent_runs_of_one", f"WITH {RUNS} SELECT * FROM runs WHERE entity = 'view' ORDER BY run_id DESC LIMIT 20")
def _(t):
    return t.runs.filter("entity = 'view'").orderBy(F.desc("run_id")).limit(20)


@query("f4_empty_parents", f"""
WITH {CUST} SELECT 'customers' AS parent, count(*) = 0 AS is_empty FROM cust
UNION ALL SELECT 'rich customers', count(*) = 0 FROM cust WHERE balance > 1000000""")
def _(t):
    found = [("customers", rows.is_empty(t.customers)),
             ("rich customers", rows.is_empty(t.customers.filter("balance > 1000000")))]
    return t.spark.createDataFrame(found, "parent string, is_empty boolean")


@query("f5_split_sample", f"""
WITH {ORD}, n AS (
  SELECT order_id, row_number() OVER (ORDER BY md5('5|sample|' || order_id)) AS idx FROM ord WHERE deleted_at IS NULL),
k AS (SELECT count(*) // 10 AS u, count(*) // 20 AS d FROM n)
SELECT order_id, idx, CASE WHEN idx <= u THEN 'update' ELSE 'delete' END AS action FROM n, k WHERE idx <= u + d""")
def _(t):
    keys = rows.live_keys(t.orders, ORDERS.pk, ORDERS.soft_delete)
    n = keys.count()
    return ranking.split_sample(keys, ORDERS.pk, 5, n // 10, n // 20)


@query("f6_listing", f"WITH {PROJECTS} SELECT * FROM proj ORDER BY name, id")
def _(t):
    return t.projects.orderBy("name", "id")


# ------------------------------------------------------------------- registry
_THINGS = f"""{CONFIGS}, {PROJECTS}, things AS (
  SELECT c.*, coalesce(p.is_only_me, TRUE) AS is_private FROM conf c LEFT JOIN proj p ON p.id = c.project_id)"""


def _things(t: Roles):
    return tenancy.with_privacy(t.configs, t.projects)


@query("t1_config_privacy", f"WITH {_THINGS} SELECT id, project_id, is_private FROM things")
def _(t):
    return _things(t).select("id", "project_id", "is_private")


_LISTED = "id, name, project_id, provider_id, is_private"


@query("t2_visible_to_one", f"WITH {_THINGS} SELECT {_LISTED} FROM things WHERE provider_id = '7' OR NOT is_private")
def _(t):
    return tenancy.visible(_things(t), "7").select(*_LISTED.split(", "))


@query("t2_mine", f"WITH {_THINGS} SELECT {_LISTED} FROM things WHERE provider_id = '7'")
def _(t):
    return tenancy.visible(_things(t), "7", scope="mine").select(*_LISTED.split(", "))


@query("t2_shared_in_project", f"""
WITH {_THINGS} SELECT {_LISTED} FROM things WHERE provider_id <> '7' AND NOT is_private AND project_id = 'prj_8'""")
def _(t):
    return tenancy.visible(_things(t), "7", scope="shared", project_id="prj_8").select(*_LISTED.split(", "))


@query("t2_superuser_shared", f"WITH {_THINGS} SELECT {_LISTED} FROM things WHERE provider_id <> '3'")
def _(t):
    return tenancy.visible(_things(t), None, "shared", superuser=True, system_owner="3").select(*_LISTED.split(", "))


@query("t2_scope_counts", f"""
WITH {_THINGS}, {PROVIDERS}
SELECT id, (SELECT count(*) FROM things t WHERE t.provider_id = p.id) AS mine,
       (SELECT count(*) FROM things t WHERE t.provider_id <> p.id AND NOT is_private) AS shared,
       (SELECT count(*) FROM things t WHERE t.provider_id = p.id OR NOT is_private) AS visible FROM prov p""")
def _(t):
    return tenancy.scope_counts(_things(t), t.providers.select("id"))


def _access_requests(t: Roles, prefix: str, n: int):
    return t.tab("events").select(
        "event_id", F.concat(F.lit(prefix), (F.col("event_id") * 7 % F.lit(n + 5)).cast("string")).alias("thing_id"),
        (F.col("user_id") % 25).cast("string").alias("principal"),
        (F.col("event_type") == "signup").alias("superuser"),
        F.when(F.col("value") < 8, "write").otherwise("read").alias("need"))


@query("t3_access_decisions", f"""
WITH {_THINGS}, req AS (
  SELECT event_id, 'cfg_' || (event_id * 7 % ((SELECT count(*) FROM part) + 5)) AS thing_id,
         CAST(user_id % 25 AS VARCHAR) AS principal, event_type = 'signup' AS superuser,
         CASE WHEN value < 8 THEN 'write' ELSE 'read' END AS need FROM events)
SELECT r.*, CASE WHEN t.id IS NULL THEN 'not_found'
    WHEN NOT (superuser OR principal = provider_id OR NOT is_private) THEN 'not_found'
    WHEN need = 'write' AND NOT (superuser OR principal = provider_id) THEN 'forbidden' ELSE 'ok' END AS decision
FROM req r LEFT JOIN things t ON t.id = r.thing_id""")
def _(t):
    n = t.tab("part").count()
    return tenancy.decide(_access_requests(t, "cfg_", n), _things(t), n)


@query("t4_provider_report", f"""
WITH {PROVIDERS}, {PROJECTS}, {CONFIGS}, {KEYS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY created_seq) AS idx FROM keys),
lists AS (SELECT provider_id, (idx - 1) // 1000 AS list_no, string_agg(id, ',' ORDER BY idx) AS items FROM n GROUP BY 1, 2)
SELECT id, full_name, is_active, (SELECT count(*) FROM proj j WHERE j.provider_id = p.id) AS project_count,
       (SELECT count(*) FROM conf c WHERE c.provider_id = p.id) AS config_count, list_no, items AS keys
FROM prov p LEFT JOIN lists l ON l.provider_id = p.id""")
def _(t):
    report = summaries.owned_counts(
        t.providers, "id", project_count=(t.projects, "provider_id"), config_count=(t.configs, "provider_id"))
    lists = summaries.listed(t.keys, "provider_id", "id", "created_seq").withColumn("keys", F.array_join("items", ","))
    return report.join(lists.drop("items"), F.col("id") == F.col("provider_id"), "left").drop("provider_id")


@query("t5_usage", f"""
WITH {PROVIDERS}, {PROJECTS}, {CONFIGS}
SELECT id, (SELECT count(*) FROM proj j WHERE j.provider_id = p.id AND source = 'api') AS projects,
       (SELECT count(*) FROM conf c WHERE c.provider_id = p.id AND source = 'api') AS configs FROM prov p""")
def _(t):
    api = F.col("source") == "api"
    return summaries.owned_counts(
        t.providers.select("id"), "id", projects=(t.projects.filter(api), "provider_id"),
        configs=(t.configs.filter(api), "provider_id"))


@query("t6_throttled_uses", """
WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL
  SELECT k.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.ts > k.ts + INTERVAL 360 MINUTE)
  FROM kept k WHERE k.ts IS NOT NULL)
SELECT user_id, ts FROM kept WHERE ts IS NOT NULL""")
def _(t):
    """Six hours instead of five minutes: the users of this log pause longer than that."""
    return tenancy.throttled_uses(t.tab("events"), "user_id", "ts", minutes=360, segment_minutes=1440)


def _wanted_names(t: Roles, on_exists: str):
    part = t.tab("part").select("p_partkey", "p_retailprice", name_key(F.col("p_name")).alias("name_key"))
    existing = part.filter("p_retailprice < 901").groupBy("name_key").agg(
        F.concat(F.lit("prov_"), F.min("p_partkey").cast("string")).alias("id"))
    return tenancy.get_or_create(
        part.select(F.col("p_partkey").alias("request_id"), "name_key"), existing, on_exists)


@query("t7_get_or_create", """
WITH req AS (SELECT p_partkey AS request_id, lower(p_name) AS name_key FROM part),
old AS (SELECT 'prov_' || min(p_partkey) AS id, lower(p_name) AS name_key FROM part
        WHERE p_retailprice < 901 GROUP BY 2),
first AS (SELECT name_key, min(request_id) AS first_id FROM req GROUP BY 1)
SELECT request_id, name_key,
  CASE WHEN o.id IS NULL AND request_id = first_id THEN 'created' ELSE 'reused' END AS outcome,
  coalesce(o.id, 'new_' || first_id) AS owner_id
FROM req JOIN first USING (name_key) LEFT JOIN old o USING (name_key)""")
def _(t):
    return _wanted_names(t, "reuse")


_FILED = f"""{CONFIGS}, {PROJECTS}, had AS (
  SELECT provider_id, min(id) AS old_id FROM proj WHERE name LIKE '%1' GROUP BY 1),
filed AS (
  SELECT conf.*, CASE WHEN source = 'yaml' THEN 'prj_system_examples'
                      ELSE coalesce(old_id, 'prj_' || md5('default|' || provider_id)) END AS group_id
  FROM conf LEFT JOIN had USING (provider_id))"""


def _filed(t: Roles):
    """Projects whose name ends in 1 stand for default groups that owners already have."""
    had = t.projects.filter(F.col("name").endswith("1")).select("id", "provider_id")
    return tenancy.file_into_groups(t.configs.drop("project_id"), had)


@query("t8_groups", f"""
WITH {_FILED} SELECT group_id AS id, bool_or(is_only_me) AS is_only_me,
  bool_or(is_only_me) AND NOT bool_and(is_only_me) AS is_mixed, count(*) AS n_members FROM filed GROUP BY 1""")
def _(t):
    return _filed(t)[0]


@query("t8_filed_configs", f"WITH {_FILED} SELECT id, provider_id, source, group_id AS project_id FROM filed")
def _(t):
    return _filed(t)[1].select("id", "provider_id", "source", "project_id")


@query("t7_refused_names", """
WITH req AS (SELECT p_partkey AS request_id, lower(p_name) AS name_key FROM part),
old AS (SELECT 'prov_' || min(p_partkey) AS id, lower(p_name) AS name_key FROM part
        WHERE p_retailprice < 901 GROUP BY 2),
first AS (SELECT name_key, min(request_id) AS first_id FROM req GROUP BY 1)
SELECT request_id, name_key,
  CASE WHEN o.id IS NULL AND request_id = first_id THEN 'created' ELSE 'already_exists' END AS outcome,
  coalesce(o.id, 'new_' || first_id) AS owner_id
FROM req JOIN first USING (name_key) LEFT JOIN old o USING (name_key)""")
def _(t):
    return _wanted_names(t, "error")


@query("t2_projects_visible_to_one", f"WITH {PROJECTS} SELECT id, name, provider_id, is_only_me FROM proj WHERE provider_id = '7' OR NOT is_only_me")
def _(t):
    things = t.projects.withColumn("is_private", F.col("is_only_me"))
    return tenancy.visible(things, "7").select("id", "name", "provider_id", "is_only_me")


@query("t3_project_decisions", f"""
WITH {PROJECTS}, req AS (
  SELECT event_id, 'prj_' || (event_id * 7 % ((SELECT count(*) FROM supplier) + 5)) AS thing_id,
         CAST(user_id % 25 AS VARCHAR) AS principal, event_type = 'signup' AS superuser,
         CASE WHEN value < 8 THEN 'write' ELSE 'read' END AS need FROM events)
SELECT r.*, CASE WHEN t.id IS NULL THEN 'not_found'
    WHEN NOT (superuser OR principal = provider_id OR NOT is_only_me) THEN 'not_found'
    WHEN need = 'write' AND NOT (superuser OR principal = provider_id) THEN 'forbidden' ELSE 'ok' END AS decision
FROM req r LEFT JOIN proj t ON t.id = r.thing_id""")
def _(t):
    n = t.tab("supplier").count()
    return tenancy.decide(_access_requests(t, "prj_", n), t.projects.withColumn("is_private", F.col("is_only_me")), n)


@query("t10_metrics", f"""
WITH {RUNS}, {CUST}, {ORD}, mine AS (
  SELECT * REPLACE (CASE WHEN entity = 'signup' THEN 'customers' WHEN entity = 'purchase' THEN 'orders' ELSE entity END AS entity) FROM runs),
ent AS (SELECT 'customers' AS entity, count(*) AS row_count FROM cust UNION ALL SELECT 'orders', count(*) FROM ord)
SELECT entity, CAST(50000 AS BIGINT) AS max_rows, arg_max(finished_at, run_id) AS last_run,
       arg_max(status, run_id) AS last_status, any_value(coalesce(row_count, 0)) AS row_count
FROM mine LEFT JOIN ent USING (entity) GROUP BY 1""")
def _(t):
    """Signups are the runs of the customers, purchases those of the orders; the rest has no rows."""
    kind = F.col("entity")
    mine = t.runs.withColumn("entity", F.when(kind == "signup", "customers").when(kind == "purchase", "orders").otherwise(kind))
    named = mine.select("entity").distinct().withColumn("max_rows", F.lit(50000).cast("bigint"))
    return tenancy.metrics(named, _entity_rows(t), mine)
