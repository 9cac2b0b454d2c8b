"""Export sinks and log files (A4-A12): rendered lines, and what reads back after writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import batches
from tidemark.operators.feed import LOG_COLUMNS, entity_latest
from tidemark.plans.catalog import (
    CUST, CUST_LATEST, CUSTOMERS, LOG, ORD, ORDERS, RUNS, TS, query,
)
from tidemark.session import scratch_path
from tidemark.sources import export, tables

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_ORDER_CELLS = f"""order_id, customer_id, CAST(amount AS VARCHAR) AS amount, status, CAST(priority AS VARCHAR) AS priority,
  CASE WHEN urgent THEN 'true' ELSE 'false' END AS urgent, note, {_ISO.format('placed_at')} AS placed_at,
  {_ISO.format('updated_at')} AS updated_at, {_ISO.format('deleted_at')} AS deleted_at, CAST(version AS VARCHAR) AS version"""


def _quoted(cell: str) -> str:
    return (f"CASE WHEN regexp_matches({cell}, '[,\"\\r\\n]') THEN '\"' || replace({cell}, '\"', '\"\"') || '\"' "
            f"ELSE {cell} END")


@query("a4_csv_lines", f"""
SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || {_quoted('text')} || ',' || lang || ',' || {_quoted('source')} AS line
FROM documents""")
def _(t):
    docs = t.tab("documents").select("doc_id", "text", "lang", "source")
    return export.csv_lines(docs, keep=["doc_id"])


@query("a4_csv_read_back", f"WITH {ORD} SELECT {_ORDER_CELLS} FROM ord")
def _(t):
    path = scratch_path(t.spark, "csv")
    export.write_csv(t.orders, path)
    schema = ", ".join(f"{c} string" for c in ORDERS.columns)
    return t.spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="")


@query("a4_hostile_csv_read_back", "SELECT doc_id, text FROM documents")
def _(t):
    """Whole documents, each with quotes, commas and all kinds of line breaks added, through a file."""
    path = scratch_path(t.spark, "csv")
    tail = ' ,;"",\t\'5" nails\', a\r\nb\rc\nd,"'
    export.write_csv(t.tab("documents").select("doc_id", F.concat("text", F.lit(tail)).alias("text")), path)
    back = t.spark.read.schema("doc_id bigint, text string").csv(
        path, header=True, multiLine=True, escape='"', lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)
    kept = F.when(F.col("text").endswith(tail), F.col("text").substr(F.lit(1), F.length("text") - len(tail)))
    return back.select("doc_id", kept.alias("text"))


@query("a5_ndjson_lines", f"""
WITH {ORD} SELECT order_id, '{{"order_id":"' || order_id || '","customer_id":"' || customer_id || '","amount":' || CAST(amount AS VARCHAR)
  || ',"status":"' || status || '","priority":' || priority || ',"urgent":' || CASE WHEN urgent THEN 'true' ELSE 'false' END
  || ',"note":"' || note || '","placed_at":"' || {_ISO.format('placed_at')} || '","updated_at":"' || {_ISO.format('updated_at')}
  || '","deleted_at":' || coalesce('"' || {_ISO.format('deleted_at')} || '"', 'null') || ',"version":' || version || '}}' AS line FROM ord""")
def _(t):
    return export.ndjson_lines(t.orders, keep=["order_id"])


@query("a5_ndjson_read_back", f"""
WITH {ORD} SELECT order_id, customer_id, amount, status, priority, urgent, note, {_ISO.format('placed_at')} AS placed_at,
  {_ISO.format('updated_at')} AS updated_at, {_ISO.format('deleted_at')} AS deleted_at, version FROM ord""")
def _(t):
    path = scratch_path(t.spark, "ndjson")
    export.write_ndjson(t.orders, path)
    shown = [f"{f.name} {'string' if f.dataType.typeName() == 'timestamp_ntz' else f.dataType.simpleString()}"
             for f in ORDERS.schema.fields]
    return t.spark.read.schema(", ".join(shown)).json(path)


_TUPLE = f"""'(''' || order_id || ''', ''' || customer_id || ''', ' || CAST(amount AS VARCHAR) || ', ''' || status || ''', '
  || priority || ', ' || CASE WHEN urgent THEN 'TRUE' ELSE 'FALSE' END || ', ''' || note || ''', '''
  || strftime(placed_at, '%Y-%m-%d %H:%M:%S') || ''', ''' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') || ''', '
  || coalesce('''' || strftime(deleted_at, '%Y-%m-%d %H:%M:%S') || '''', 'NULL') || ', ' || version || ')'"""


@query("a6_sql_statements", f"""
WITH {ORD}, n AS (SELECT {_TUPLE} AS tup, row_number() OVER (ORDER BY order_id) AS idx FROM ord)
SELECT (idx - 1) // 500 AS statement_no, 'INSERT INTO orders ({', '.join(ORDERS.columns)}) VALUES' || chr(10)
  || string_agg(tup, ',' || chr(10) ORDER BY idx) || ';' AS statement, count(*) AS n_rows FROM n GROUP BY 1""")
def _(t):
    return export.sql_statements(t.orders, "orders", "order_id", dialect="postgresql")


@query("a6_sql_lines_read_back", f"""
WITH {ORD} SELECT count(*) + 1 + CAST(ceil(count(*) / 500.0) AS BIGINT) AS n_lines,
  CAST(ceil(count(*) / 500.0) AS BIGINT) AS n_statements, count(*) FILTER (urgent) AS n_urgent FROM ord""")
def _(t):
    path = scratch_path(t.spark, "sql")
    export.write_sql(t.orders, path, "orders", "order_id", dialect="postgresql")
    line = F.col("value")
    return t.spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(line.startswith("INSERT INTO orders (")).alias("n_statements"),
        F.count_if(line.contains(", TRUE, ")).alias("n_urgent"))


@query("a8_exported_changes", f"""
WITH {LOG}, {CUST}
SELECT l.op, l.pk_value AS customer_id, c.name, c.segment, CAST(c.balance AS VARCHAR) AS balance,
       {_ISO.format('c.deleted_at')} AS deleted_at, CAST(l.version AS VARCHAR) AS version, {CUST_LATEST} AS to_cursor
FROM chg l LEFT JOIN cust c ON c.customer_id = l.pk_value
WHERE l.entity = 'customers' AND l.version > {CUST_LATEST} // 2""")
def _(t):
    """A change export through a CSV file, with the cursor it was taken at."""
    path = scratch_path(t.spark, "export")
    since = entity_latest(t.log, "customers") // 2
    done = export.export_table(CUSTOMERS, t.customers, t.log, path, "csv", since=since)
    schema = ", ".join(f"{c} string" for c in ["op", *CUSTOMERS.columns])
    back = t.spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="")
    return back.withColumn("to_cursor", F.lit(done.to_cursor).cast("bigint"))


@query("a9_bundle_manifest", f"""
WITH {LOG}, {CUST}, {ORD}
SELECT 0 AS load_position, 'customers' AS entity, 'customers.ndjson' AS file, 'snapshot' AS kind,
       (SELECT count(*) FROM cust WHERE deleted_at IS NULL) AS n_rows, CAST(NULL AS BIGINT) AS from_cursor,
       (SELECT max(version) FROM chg WHERE entity = 'customers') AS to_cursor
UNION ALL SELECT 1, 'orders', 'orders.changes.ndjson', 'changes',
       (SELECT count(*) FROM ord) - (SELECT count(*) FROM ord) // 4, (SELECT count(*) FROM ord) // 4,
       (SELECT max(version) FROM chg WHERE entity = 'orders')""")
def _(t):
    path = scratch_path(t.spark, "bundle")
    manifest = export.write_bundle(
        {"orders": ORDERS, "customers": CUSTOMERS}, {"orders": t.orders, "customers": t.customers}, t.log, path,
        fmt="ndjson", since={"orders": t.tab("orders").count() // 4})
    found = [(i, f["entity"], f["file"], f["kind"], f["rows"], f.get("from_cursor"),
              f.get("snapshot_cursor", f.get("to_cursor"))) for i, f in enumerate(manifest["files"])]
    return t.spark.createDataFrame(
        found, "load_position int, entity string, file string, kind string, n_rows bigint, from_cursor bigint, to_cursor bigint")


@query("a10_counted_rows", "SELECT count(*) AS n_rows FROM lineitem")
def _(t):
    """Counted by an observation while the rows are written, not by a second pass."""
    out, seen = export.counted(t.tab("lineitem"))
    out.write.parquet(scratch_path(t.spark, "counted"))
    return t.spark.createDataFrame([(seen.get["rows"],)], "n_rows bigint")


@query("a11_appended_log", f"WITH {LOG} SELECT * FROM chg")
def _(t):
    path = scratch_path(t.spark, "log")
    tables.append_log(t.customers_log, path)
    tables.append_log(t.orders_log, path)
    return tables.read_log(t.spark, path).select(LOG_COLUMNS)


@query("a12_run_history", f"""
WITH {RUNS} SELECT * FROM runs UNION ALL
SELECT (SELECT max(run_id) + 1 FROM runs), 'orders', {TS}, {TS}, CAST(12 AS BIGINT), CAST(5 AS BIGINT), CAST(1 AS BIGINT), 'success'
UNION ALL SELECT (SELECT max(run_id) + 2 FROM runs), 'orders', {TS}, {TS}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'failed'""")
def _(t):
    path = scratch_path(t.spark, "runs")
    tables.append_run(t.runs, path)
    last = t.runs.agg(F.max("run_id")).first()[0]
    done = {"inserted": 12, "updated": 5, "deleted": 1}
    tables.append_run(batches.run_record(t.spark, last + 1, "orders", t.ts, done), path)
    tables.append_run(batches.run_record(t.spark, last + 2, "orders", t.ts, None), path)
    return t.spark.read.schema(t.runs.schema).parquet(path)
