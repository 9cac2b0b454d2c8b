"""The register of queries and the roles the given tables play in them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.draws import FIRST_NAMES, JOB_TITLES, LAST_NAMES, MAIL_DOMAINS
from tidemark.schema import Table, declare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under ``name`` with its SQL, if it has one."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------- declared tables
CUSTOMERS: Table = declare({
    "entity": "customers",
    "fields": {
        "customer_id": {"type": "uuid", "primary_key": True},
        "name": {"type": "string", "key_label": "full_name"},
        "segment": {"type": "enum", "values": [
            "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
        "balance": {"type": "float", "min": 0, "max": 9999.99},
        "deleted_at": {"type": "timestamp", "auto": "soft_delete"},
    },
    "seed": {"initial_count": 140},
    "update_schedule": {"cadence": "daily", "new_records": [3, 9], "mutate_existing_pct": 8,
                        "soft_delete_pct": 2},
})
ORDERS_CONFIG = {
    "entity": "orders",
    "fields": {
        "order_id": {"type": "uuid", "primary_key": True},
        "customer_id": {"type": "ref", "ref_entity": "customers"},
        "amount": {"type": "float", "min": 25, "max": 875},
        "status": {"type": "enum", "values": ["F", "O", "P"]},
        "priority": {"type": "int", "min": 1, "max": 5},
        "urgent": {"type": "bool"},
        "note": {"type": "string", "nullable": True},
        "placed_at": {"type": "timestamp"},
        "updated_at": {"type": "timestamp", "auto": "updated"},
        "deleted_at": {"type": "timestamp", "auto": "soft_delete"},
    },
    "seed": {"initial_count": 600},
    "update_schedule": {"cadence": "hourly", "new_records": [7, 24], "mutate_existing_pct": 4,
                        "soft_delete_pct": 3},
}
ORDERS: Table = declare(ORDERS_CONFIG, siblings=["customers"])

BATCH_TS = "2024-06-01 12:00:00"
TS = f"TIMESTAMP '{BATCH_TS}'"

# ------------------------------------------------------------------ roles, SQL
LOG = """chg AS (
  SELECT 'customers' AS entity, CAST(user_id AS VARCHAR) AS pk_value,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
         event_id + 1 AS version, ts AS changed_at FROM events
  UNION ALL
  SELECT 'orders', CAST(o_orderkey AS VARCHAR),
         CASE o_orderstatus WHEN 'P' THEN 'insert' WHEN 'F' THEN 'delete' ELSE 'update' END,
         o_orderkey + 1, o_orderdate FROM orders)"""
CUST = """cust AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, c_mktsegment AS segment,
         c_acctbal AS balance,
         CASE WHEN c_acctbal > 9000 THEN TIMESTAMP '2001-09-01 00:00:00' END AS deleted_at,
         c_custkey + 1 AS version
  FROM customer)"""
# Without the customers in debt: keys that orders and log entries name are missing.
SOLVENT = CUST.replace("FROM customer)", "FROM customer WHERE c_acctbal >= 0)")
ORD = """ord AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         o_totalprice AS amount, o_orderstatus AS status,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
         o_orderpriority = '1-URGENT' AS urgent, o_orderpriority AS note,
         o_orderdate AS placed_at, o_orderdate AS updated_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at,
         o_orderkey + 1 AS version FROM orders)"""
RUNS = """runs AS (
  SELECT event_id AS run_id, event_type AS entity, ts AS started_at, ts AS finished_at,
         CAST(value AS BIGINT) AS rows_inserted, CAST(0 AS BIGINT) AS rows_mutated,
         CAST(0 AS BIGINT) AS rows_deleted,
         CASE WHEN value >= 10 THEN 'success' ELSE 'failed' END AS status FROM events)"""
PROVIDERS = """prov AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS full_name, n_regionkey <> 4 AS is_active
  FROM nation)"""
KEYS = """keys AS (
  SELECT 'key_' || c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS provider_id,
         sha256('secret-' || c_custkey) AS key_hash, c_custkey AS created_seq,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS revoked_at
  FROM customer)"""
PROJECTS = """proj AS (
  SELECT 'prj_' || s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS provider_id, s_name AS name,
         s_acctbal < 0 AS is_only_me,
         CASE WHEN s_suppkey < s_nationkey THEN 'yaml' ELSE 'api' END AS source FROM supplier)"""
CONFIGS = """conf AS (
  SELECT 'cfg_' || p_partkey AS id, p_partkey AS seq, p_name AS name,
         'prj_' || (p_partkey % ((SELECT count(*) FROM supplier) + 1)) AS project_id,
         CAST(p_size % 25 AS VARCHAR) AS provider_id,
         CASE WHEN p_brand = 'Brand#1' THEN 'yaml' ELSE 'api' END AS source,
         p_retailprice > 1050 AS is_only_me
  FROM part)"""
CUST_LATEST = "(SELECT max(event_id) + 1 FROM events)"


# --------------------------------------------------------------- roles, Spark
class Roles:
    """The given tables under the names the operators know them by."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def tab(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def ts(self):
        return F.to_timestamp_ntz(F.lit(BATCH_TS))

    @cached_property
    def customers_log(self) -> DataFrame:
        op = (F.when(F.col("event_type") == "signup", "insert")
              .when(F.col("event_type") == "error", "delete").otherwise("update"))
        return self.tab("events").select(
            F.lit("customers").alias("entity"), F.col("user_id").cast("string").alias("pk_value"),
            op.alias("op"), (F.col("event_id") + 1).alias("version"), F.col("ts").alias("changed_at"))

    @cached_property
    def orders_log(self) -> DataFrame:
        op = (F.when(F.col("o_orderstatus") == "P", "insert")
              .when(F.col("o_orderstatus") == "F", "delete").otherwise("update"))
        return self.tab("orders").select(
            F.lit("orders").alias("entity"), F.col("o_orderkey").cast("string").alias("pk_value"),
            op.alias("op"), (F.col("o_orderkey") + 1).alias("version"),
            F.col("o_orderdate").alias("changed_at"))

    @cached_property
    def log(self) -> DataFrame:
        return self.customers_log.unionByName(self.orders_log)

    @cached_property
    def customers(self) -> DataFrame:
        gone = F.to_timestamp_ntz(F.lit("2001-09-01 00:00:00"))
        return self.tab("customer").select(
            F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
            F.when(F.col("c_acctbal") > 9000, gone).alias("deleted_at"),
            (F.col("c_custkey") + 1).alias("version"))

    @cached_property
    def solvent(self) -> DataFrame:
        """Customers without those in debt, for what tests missing keys."""
        return self.customers.filter("balance >= 0")

    @cached_property
    def orders(self) -> DataFrame:
        day = F.col("o_orderdate")
        return self.tab("orders").select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
            (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.col("o_orderpriority").alias("note"), day.alias("placed_at"), day.alias("updated_at"),
            F.when(F.col("o_orderstatus") == "F", day).alias("deleted_at"),
            (F.col("o_orderkey") + 1).alias("version"))

    @cached_property
    def runs(self) -> DataFrame:
        none = F.lit(0).cast("bigint")
        return self.tab("events").select(
            F.col("event_id").alias("run_id"), F.col("event_type").alias("entity"),
            F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"),
            F.rint("value").cast("bigint").alias("rows_inserted"),
            none.alias("rows_mutated"), none.alias("rows_deleted"),
            F.when(F.col("value") >= 10, "success").otherwise("failed").alias("status"))

    @cached_property
    def providers(self) -> DataFrame:
        return self.tab("nation").select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("full_name"),
            (F.col("n_regionkey") != 4).alias("is_active"))

    @cached_property
    def keys(self) -> DataFrame:
        number = F.col("c_custkey").cast("string")
        return self.tab("customer").select(
            F.concat(F.lit("key_"), number).alias("id"),
            F.col("c_nationkey").cast("string").alias("provider_id"),
            F.sha2(F.concat(F.lit("secret-"), number), 256).alias("key_hash"),
            F.col("c_custkey").alias("created_seq"),
            F.when(F.col("c_acctbal") < 0, F.to_timestamp_ntz(F.lit("2023-01-01 00:00:00"))).alias("revoked_at"))

    @cached_property
    def projects(self) -> DataFrame:
        return self.tab("supplier").select(
            F.concat(F.lit("prj_"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_nationkey").cast("string").alias("provider_id"), F.col("s_name").alias("name"),
            (F.col("s_acctbal") < 0).alias("is_only_me"),
            F.when(F.col("s_suppkey") < F.col("s_nationkey"), "yaml").otherwise("api").alias("source"))

    @cached_property
    def configs(self) -> DataFrame:
        n = self.tab("supplier").count()
        return self.tab("part").select(
            F.concat(F.lit("cfg_"), F.col("p_partkey").cast("string")).alias("id"),
            F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"),
            F.concat(F.lit("prj_"), (F.col("p_partkey") % F.lit(n + 1)).cast("string")).alias("project_id"),
            (F.col("p_size") % 25).cast("string").alias("provider_id"),
            F.when(F.col("p_brand") == "Brand#1", "yaml").otherwise("api").alias("source"),
            (F.col("p_retailprice") > 1050).alias("is_only_me"))


# ------------------------------------------------- seeded values, SQL wording
def draw_sql(seed, table: str, field: str, row: str) -> str:
    return (f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{table}', '{field}', "
            f"CAST({row} AS VARCHAR))), 1, 15) AS BIGINT)")


def pick_sql(h: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({h} % {len(values)} + 1 AS INTEGER)]"


def uuid_sql(seed, table: str, field: str, row: str) -> str:
    m = f"md5(concat_ws('|', '{seed}', '{table}', '{field}', CAST({row} AS VARCHAR)))"
    variant = f"translate(substr({m}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (f"substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-4' || substr({m}, 14, 3) || '-' || "
            f"{variant} || substr({m}, 18, 3) || '-' || substr({m}, 21, 12)")


def letters_sql(h: str, length: int = 8) -> str:
    return " || ".join(f"chr(CAST(97 + ({h} // {26 ** j}) % 26 AS INTEGER))" for j in reversed(range(length)))


def name_sql(seed, table: str, field: str, row: str) -> str:
    first = pick_sql(draw_sql(seed, table, f"{field}.first", row), FIRST_NAMES)
    last = pick_sql(draw_sql(seed, table, f"{field}.last", row), LAST_NAMES)
    return f"{first} || ' ' || {last}"


def email_sql(seed, table: str, field: str, row: str) -> str:
    first = pick_sql(draw_sql(seed, table, f"{field}.first", row), FIRST_NAMES)
    last = pick_sql(draw_sql(seed, table, f"{field}.last", row), LAST_NAMES)
    tail = draw_sql(seed, table, f"{field}.tail", row)
    host = pick_sql(f"({tail} >> 16)", MAIL_DOMAINS)
    return f"lower({first}) || '.' || lower({last}) || ({tail} % 10000) || '@' || {host}"


def job_sql(seed, table: str, field: str, row: str) -> str:
    return pick_sql(draw_sql(seed, table, field, row), JOB_TITLES)


def customer_values_sql(seed, row: str, table: str = "customers") -> dict[str, str]:
    h = lambda f: draw_sql(seed, table, f, row)
    return {
        "customer_id": uuid_sql(seed, table, "customer_id", row),
        "name": name_sql(seed, table, "name", row),
        "segment": pick_sql(h("segment"), CUSTOMERS.schema["segment"].metadata["values"]),
        "balance": f"({h('balance')} % 1000000) / 100.0::DOUBLE",
    }


def order_values_sql(seed, row: str, table: str = "orders") -> dict[str, str]:
    h = lambda f: draw_sql(seed, table, f, row)
    return {
        "order_id": uuid_sql(seed, table, "order_id", row),
        "amount": f"(2500 + {h('amount')} % 85001) / 100.0::DOUBLE",
        "status": pick_sql(h("status"), ["F", "O", "P"]),
        "priority": f"1 + {h('priority')} % 5",
        "urgent": f"{h('urgent')} % 2 = 0",
        "note": letters_sql(h("note")),
        "placed_at": TS,
    }
