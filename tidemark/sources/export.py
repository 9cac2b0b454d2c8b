"""Export sinks: CSV, NDJSON, SQL text, and bundles of all of a group's tables.

Every sink writes a folder of part files in parallel; nothing is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from tidemark.functions.text import csv_cell, csv_quoted, iso_text, sql_literal
from tidemark.operators.feed import CursorAhead, delta, entity_latest
from tidemark.operators.ranking import chunked, index_sorted
from tidemark.schema import Table, load_order
from tidemark.sources.tables import snapshot

# Formats, dialects and the size of one INSERT statement.
FORMATS = ["csv", "ndjson", "sql"]
CHANGE_FORMATS = ["csv", "ndjson"]
DIALECTS = ["postgresql", "sqlite"]
ROWS_PER_INSERT = 500

# Names that need quoting in SQL text.
RESERVED_WORDS = [
    "all", "alter", "and", "any", "as", "asc", "between", "by", "case", "check", "column",
    "constraint", "create", "cross", "current_date", "current_time", "current_timestamp",
    "default", "delete", "desc", "distinct", "drop", "else", "end", "except", "exists", "false",
    "foreign", "from", "full", "grant", "group", "having", "in", "index", "inner", "insert",
    "intersect", "into", "is", "join", "left", "like", "limit", "not", "null", "offset", "on",
    "or", "order", "outer", "primary", "references", "right", "select", "set", "table", "then",
    "to", "true", "union", "unique", "update", "user", "using", "values", "when", "where", "with",
]


# ----------------------------------------------------------------------- lines
def csv_cells(df: DataFrame) -> list[Column]:
    return [csv_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]


def csv_lines(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One CSV line per row, minimal quoting; an empty cell that is a line of its own is quoted, or it would be no line."""
    cells = [csv_quoted(csv_cell(F.col(f.name), f.dataType)) for f in df.schema.fields]
    if len(cells) == 1:
        cells = [F.when(cells[0] == "", '""').otherwise(cells[0])]
    return df.select(*keep, F.concat_ws(",", *cells).alias("line"))


def _iso_times(df: DataFrame) -> DataFrame:
    return df.select(*[
        iso_text(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (TimestampNTZType, TimestampType)) else F.col(f.name)
        for f in df.schema.fields])


def ndjson_lines(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One JSON object per row; NULL fields stay."""
    shown = _iso_times(df)
    whole = F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"})
    return shown.select(*keep, whole.alias("line"))


def quoted_name(name: str) -> str:
    plain = name.isidentifier() and name == name.lower() and name not in RESERVED_WORDS
    return name if plain else '"' + name.replace('"', '""') + '"'


def sql_tuple(df: DataFrame, dialect: str = "sqlite") -> Column:
    """The parenthesised VALUES tuple of a row of ``df``."""
    literals = [sql_literal(F.col(f.name), f.dataType, dialect) for f in df.schema.fields]
    return F.concat(F.lit("("), F.concat_ws(", ", *literals), F.lit(")"))


def sql_statements(df: DataFrame, name: str, order: str, dialect: str = "sqlite",
                   size: int = ROWS_PER_INSERT) -> DataFrame:
    """INSERT statements of at most ``size`` rows in ``order``: the groups are cut by a dense
    index, so each one is small whatever the data."""
    head = f"INSERT INTO {quoted_name(name)} ({', '.join(map(quoted_name, df.columns))}) VALUES\n"
    numbered = chunked(index_sorted(df, [order], out="_idx"), size, idx="_idx", out="statement_no")
    # rendered after the sort: it then runs once per row, on every partition
    lines = numbered.select("statement_no", "_idx", sql_tuple(df, dialect).alias("tuple"))
    in_order = F.array_sort(F.collect_list(F.struct("_idx", "tuple")))
    body = F.array_join(F.transform(in_order, lambda t: t["tuple"]), ",\n")
    return lines.groupBy("statement_no").agg(
        F.concat(F.lit(head), body, F.lit(";")).alias("statement"), F.count(F.lit(1)).alias("n_rows"))


# ----------------------------------------------------------------------- sinks
def counted(df: DataFrame, rows: Column | None = None) -> tuple[DataFrame, Observation]:
    """Count what passes through, without a second pass. Place it last before the write:
    only there does Spark count each row once whatever is sampled or recomputed upstream."""
    seen = Observation()
    n = F.count(F.lit(1)) if rows is None else F.coalesce(F.sum(rows), F.lit(0))
    return df.observe(seen, n.alias("rows")), seen


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*csv_cells(df)).write.csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue='""' if len(df.columns) == 1 else "", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_ndjson(df: DataFrame, path: str) -> None:
    _iso_times(df).write.option("ignoreNullFields", "false").json(path)


def write_sql(df: DataFrame, path: str, name: str, order: str, dialect: str = "sqlite") -> int:
    """Writes INSERT statements; returns the number of rows in them."""
    statements = sql_statements(df, name, order, dialect).orderBy("statement_no")
    statements, seen = counted(statements, F.col("n_rows"))
    note = F.when(F.col("statement_no") == 0, F.lit(f"-- {name}: INSERT statements ({dialect})\n")).otherwise("")
    statements.select(F.concat(note, F.col("statement"))).write.text(path)
    return seen.get["rows"]


@dataclass(frozen=True)
class Exported:
    kind: str
    rows: int
    from_cursor: int | None
    to_cursor: int


def check_format(fmt: str, dialect: str, changes: bool) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"invalid_format: '{fmt}' is not one of {FORMATS}")
    if dialect not in DIALECTS:
        raise ValueError(f"invalid_dialect: '{dialect}' is not one of {DIALECTS}")
    if changes and fmt not in CHANGE_FORMATS:
        raise ValueError(f"unsupported_format: changes come as {CHANGE_FORMATS}")


def export_table(table: Table, rows: DataFrame, log: DataFrame, path: str, fmt: str = "csv",
                 since: int | None = None, include_deleted: bool = False,
                 dialect: str = "sqlite") -> Exported:
    """Write a snapshot, or the changes after ``since``.

    The cursor is taken before any row is read, so a snapshot holds every change up to it
    and applying the changes after it again does no harm.
    """
    check_format(fmt, dialect, since is not None)
    upto = entity_latest(log, table.name)
    if since is not None and since > upto:
        raise CursorAhead(table.name, since, upto)
    if since is None:
        out = snapshot(rows, table, include_deleted)
    else:
        out = delta(log, rows, table.name, table.pk, since, upto).select("op", *table.columns)
    if fmt == "sql":
        return Exported("snapshot", write_sql(out, path, table.name, table.pk, dialect), None, upto)
    # a change export is ordered by version, a snapshot by key
    out, seen = counted(out.orderBy(table.pk if since is None else "version"))
    write = write_csv if fmt == "csv" else write_ndjson
    write(out, path)
    return Exported("snapshot" if since is None else "changes", seen.get["rows"], since, upto)


def write_bundle(tables: Mapping[str, Table], data: Mapping[str, DataFrame], log: DataFrame, path: str,
                 fmt: str = "csv", entities: list[str] | None = None, since: Mapping[str, int] | None = None,
                 include_deleted: bool = False, dialect: str = "sqlite", generated_at: str | None = None) -> dict:
    """One folder per table, parents first, plus manifest.json (in its own folder). Tables
    named in ``since`` come as changes, the others as snapshots. Returns the manifest."""
    since = dict(since or {})
    check_format(fmt, dialect, bool(since))
    unknown = sorted((set(entities or []) | set(since)) - set(tables))
    if unknown:
        raise ValueError(f"unknown_entity: {unknown}")
    targets = [t for t in load_order(dict(tables)) if not entities or t in entities]
    if set(since) - set(targets):
        raise ValueError(f"since_not_targeted: {sorted(set(since) - set(targets))}")
    files = []
    for name in targets:
        folder = f"{name}.changes.{fmt}" if name in since else f"{name}.{fmt}"
        done = export_table(tables[name], data[name], log, f"{path}/{folder}", fmt, since.get(name),
                            include_deleted, dialect)
        cursors = ({"snapshot_cursor": done.to_cursor} if done.kind == "snapshot"
                   else {"from_cursor": done.from_cursor, "to_cursor": done.to_cursor})
        files.append({"entity": name, "file": folder, "rows": done.rows, "kind": done.kind, **cursors})
    manifest = {"generated_at": generated_at, "format": fmt, "dialect": dialect,
                "load_order": targets, "files": files}
    spark = log.sparkSession
    spark.range(1).select(F.lit(json.dumps(manifest, indent=2))).coalesce(1).write.text(f"{path}/manifest.json")
    return manifest
