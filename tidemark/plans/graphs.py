"""Reference graph and set operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans.catalog import CONFIGS, CUST, ORD, SOLVENT, Roles, query

# Rows as nodes: an order references its customer, a customer its nation, a nation its region.
ROW_EDGES = """edges AS (
  SELECT 'order:' || o_orderkey AS child, 'customer:' || o_custkey AS parent FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
ROW_NODES = """nodes AS (
  SELECT 'order:' || o_orderkey AS node FROM orders UNION ALL SELECT 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region)"""
# Parts pointing at the part numbered by their size: some chains end, others run in circles.
POINTERS = """edges AS (
  SELECT 'p' || p_partkey AS child, 'p' || p_size AS parent FROM part WHERE p_type <> 'SMALL'),
nodes AS (SELECT 'p' || p_partkey AS node FROM part)"""


def _name(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edges(t: Roles):
    def pairs(table, kind, key, parent_kind, parent_key):
        return t.tab(table).select(_name(kind, key).alias("child"), _name(parent_kind, parent_key).alias("parent"))

    return (pairs("orders", "order", "o_orderkey", "customer", "o_custkey")
            .unionByName(pairs("customer", "customer", "c_custkey", "nation", "c_nationkey"))
            .unionByName(pairs("nation", "nation", "n_nationkey", "region", "n_regionkey")))


def _nodes(t: Roles):
    def names(table, kind, key):
        return t.tab(table).select(_name(kind, key).alias("node"))

    return (names("orders", "order", "o_orderkey").unionByName(names("customer", "customer", "c_custkey"))
            .unionByName(names("nation", "nation", "n_nationkey"))
            .unionByName(names("region", "region", "r_regionkey")))


def _pointers(t: Roles):
    def number(c):
        return F.concat(F.lit("p"), F.col(c).cast("string"))

    part = t.tab("part")
    return (part.select(number("p_partkey").alias("node")),
            part.filter("p_type <> 'SMALL'").select(number("p_partkey").alias("child"), number("p_size").alias("parent")))


@query("g1_not_targeted", f"""
WITH {CUST}, {ORD} SELECT customer_id, name FROM cust
WHERE customer_id NOT IN (SELECT customer_id FROM ord WHERE amount > 400000)""")
def _(t):
    return graph.difference(t.customers.select("customer_id", "name"), t.orders.filter("amount > 400000"), "customer_id")


@query("g1_union_of_keys", f"WITH {CUST}, {ORD} SELECT customer_id FROM cust UNION SELECT customer_id FROM ord")
def _(t):
    return graph.union_keys("customer_id", t.customers, t.orders)


@query("g2_mirrored_registry", f"""
WITH {CONFIGS}, incoming AS (
  SELECT 'cfg_' || s_suppkey * 3 AS id, s_name AS name, 'prj_' || s_nationkey AS project_id FROM supplier),
mine AS (SELECT * FROM conf WHERE source = 'yaml')
SELECT coalesce(m.id, i.id) AS id, coalesce(i.name, m.name) AS name,
       coalesce(i.project_id, m.project_id) AS project_id, m.seq, 'yaml' AS source,
       CASE WHEN i.id IS NOT NULL THEN TIMESTAMP '2024-06-01 12:00:00' END AS updated_at,
       CASE WHEN m.id IS NOT NULL AND i.id IS NOT NULL THEN 'updated' WHEN m.id IS NOT NULL THEN 'deleted' ELSE 'inserted' END AS action
FROM mine m FULL JOIN incoming i ON i.id = m.id
UNION ALL SELECT id, name, project_id, seq, source, NULL, 'kept' FROM conf WHERE source <> 'yaml'""")
def _(t):
    registry = t.configs.select("id", "name", "project_id", "seq", "source").withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    incoming = t.tab("supplier").select(
        F.concat(F.lit("cfg_"), (F.col("s_suppkey") * 3).cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("prj_"), F.col("s_nationkey").cast("string")).alias("project_id"))
    return graph.mirror(registry, incoming, "yaml", t.ts)


@query("g3_dependents_closure", f"""
WITH RECURSIVE {ROW_EDGES}, reached AS (
  SELECT 'region:2' AS node, 0 AS steps
  UNION SELECT child, steps + 1 FROM edges JOIN reached ON parent = node)
SELECT * FROM reached""")
def _(t):
    """Every row that hangs on one region."""
    seeds = t.tab("region").filter("r_regionkey = 2").select(_name("region", "r_regionkey").alias("node"))
    return graph.closure(_edges(t), seeds)


@query("g3_dependent_rows", f"""
SELECT l_orderkey, count(*) AS n_items FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey = 2 GROUP BY 1""")
def _(t):
    nations = t.tab("nation").filter("n_regionkey = 2")
    customers = graph.referencing(t.tab("customer"), "c_nationkey", nations, "n_nationkey")
    orders = graph.referencing(t.tab("orders"), "o_custkey", customers, "c_custkey")
    items = graph.referencing(t.tab("lineitem"), "l_orderkey", orders, "o_orderkey")
    return items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))


@query("g4_ancestors_closure", f"""
WITH RECURSIVE {ROW_EDGES}, reached AS (
  SELECT 'order:' || o_orderkey AS node, 0 AS steps FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT parent, steps + 1 FROM edges JOIN reached ON child = node)
SELECT * FROM reached""")
def _(t):
    urgent = t.tab("orders").filter("o_orderpriority = '1-URGENT'").select(_name("order", "o_orderkey").alias("node"))
    return graph.closure(_edges(t), urgent, towards="parents")


@query("g4_needed_rows", """
SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    sample = t.tab("orders").filter("o_orderstatus = 'P'")
    return graph.referenced(t.tab("customer"), "c_custkey", sample, "o_custkey").select("c_custkey", "c_nationkey")


@query("g5_levels", f"""
WITH RECURSIVE {ROW_EDGES}, {ROW_NODES}, walk AS (
  SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT child FROM edges)
  UNION SELECT child, level + 1 FROM edges JOIN walk ON parent = node)
SELECT node, max(level) AS level FROM walk GROUP BY 1""")
def _(t):
    return graph.levels(_nodes(t), _edges(t)).orderBy("level", "node")


# A node has a level when walking up its parent chain ends; 60 steps exceed every chain of 50 sizes.
_WALK = f"""{POINTERS}, up AS (
  SELECT node AS start, node, 0 AS steps FROM nodes
  UNION SELECT start, parent, steps + 1 FROM up JOIN edges ON child = node WHERE steps < 60),
depth AS (SELECT start, max(steps) AS steps FROM up GROUP BY 1)"""


@query("g6_levels_with_cycles", f"""
WITH RECURSIVE {_WALK} SELECT start AS node, CASE WHEN steps < 60 THEN steps END AS level FROM depth""")
def _(t):
    return graph.levels(*_pointers(t))


@query("g6_stuck_edges", f"""
WITH RECURSIVE {_WALK} SELECT DISTINCT child, parent FROM edges JOIN depth ON start = child WHERE steps >= 60""")
def _(t):
    return graph.stuck_edges(_pointers(t)[1])


@query("g6_stuck_parts", f"""
WITH RECURSIVE {_WALK}, circles AS (
  SELECT start, min(node) AS cycle FROM up
  WHERE start IN (SELECT start FROM up WHERE steps > 0 AND node = start) GROUP BY 1)
SELECT DISTINCT child, parent, CASE WHEN c.cycle = p.cycle THEN c.cycle END AS cycle
FROM edges JOIN depth ON start = child LEFT JOIN circles c ON c.start = child LEFT JOIN circles p ON p.start = parent
WHERE steps >= 60""")
def _(t):
    return graph.stuck_parts(_pointers(t)[1])


# Orders as a deep tree: seven of eight keys need the key before, the eighth the one of half its key.
TREE = """edges AS (
  SELECT o_orderkey AS child, CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey - 1 ELSE o_orderkey // 2 END AS parent
  FROM orders WHERE o_orderkey > 0)"""


def _tree(t: Roles):
    key = F.col("o_orderkey")
    return t.tab("orders").where("o_orderkey > 0").select(
        key.alias("child"), F.when(key % 8 > 0, key - 1).otherwise(F.floor(key / 2)).cast("long").alias("parent"))


@query("g5_deep_levels", f"""
WITH RECURSIVE {TREE}, walk AS (
  SELECT parent AS node, 0 AS level FROM edges WHERE parent NOT IN (SELECT child FROM edges)
  UNION SELECT child, level + 1 FROM edges JOIN walk ON parent = node)
SELECT o_orderkey AS node, coalesce(max(level), 0) AS level FROM orders LEFT JOIN walk ON node = o_orderkey GROUP BY 1""")
def _(t):
    return graph.levels(t.tab("orders").select(F.col("o_orderkey").alias("node")), _tree(t))


@query("g3_deep_closure", f"""
WITH RECURSIVE {TREE}, reached AS (
  SELECT 0::BIGINT AS node, 0 AS steps
  UNION SELECT child, steps + 1 FROM edges JOIN reached ON parent = node)
SELECT node, min(steps) AS steps FROM reached GROUP BY 1""")
def _(t):
    """All that hangs on the first order, by the least number of steps."""
    return graph.closure(_tree(t), t.tab("orders").where("o_orderkey = 0").select(F.col("o_orderkey").alias("node")))


@query("g6_dangling_edges", f"""
WITH {ROW_EDGES}, {SOLVENT} SELECT child, parent FROM edges WHERE parent LIKE 'customer:%'
  AND substr(parent, 10) NOT IN (SELECT customer_id FROM cust)""")
def _(t):
    edges = _edges(t).filter("parent LIKE 'customer:%'")
    return graph.dangling(edges, t.solvent.select(_name("customer", "customer_id").alias("node")))


@query("g7_direct_dependents", f"""
WITH {ROW_EDGES} SELECT child, parent FROM edges
WHERE parent IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(t):
    closing = t.tab("customer").filter("c_acctbal < 0").select(_name("customer", "c_custkey").alias("node"))
    return graph.direct_dependents(_edges(t), closing)
