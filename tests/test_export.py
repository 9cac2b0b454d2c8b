"""Sinks: what is written can be loaded elsewhere."""

from __future__ import annotations

import csv
import glob
import io
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.operators.feed import CursorAhead
from tidemark.sources import export, tables

HOSTILE = '5" nails, 7\' boards; "x"" y",\n--end\t;,\'\''


def read_parts(path, pattern="part-*"):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{path}/{pattern}")))


@pytest.fixture
def hostile(spark):
    return spark.createDataFrame(
        [(1, HOSTILE, 12.5, True, None), (2, None, 12345678.9, False, "2024-01-01 00:00:00.5"), (3, " padded ", 0.1, None, None)],
        "id bigint, note string, x double, ok boolean, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_csv_is_read_by_another_parser(hostile, scratch):
    path = scratch("csv")
    export.write_csv(hostile.coalesce(1), path)
    rows = list(csv.reader(io.StringIO(read_parts(path))))
    assert rows[0] == ["id", "note", "x", "ok", "at"]
    assert rows[1] == ["1", HOSTILE, "12.5", "true", ""]
    assert rows[2] == ["2", "", "12345678.9", "false", "2024-01-01T00:00:00.500000"]
    assert rows[3] == ["3", " padded ", "0.1", "", ""]


def test_csv_lines_equal_the_standard_writer(hostile):
    lines = [r.line for r in export.csv_lines(hostile, keep=["id"]).orderBy("id").collect()]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([
        [1, HOSTILE, 12.5, "true", ""], [2, "", 12345678.9, "false", "2024-01-01T00:00:00.500000"], [3, " padded ", 0.1, "", ""]])
    assert "\n".join(lines) + "\n" == out.getvalue()


def test_ndjson_keeps_null_fields(hostile, scratch):
    path = scratch("ndjson")
    export.write_ndjson(hostile.coalesce(1), path)
    rows = [json.loads(line) for line in read_parts(path).splitlines()]
    assert rows[0] == {"id": 1, "note": HOSTILE, "x": 12.5, "ok": True, "at": None}
    assert rows[1]["at"] == "2024-01-01T00:00:00.500000" and rows[1]["note"] is None
    lines = [json.loads(r.line) for r in export.ndjson_lines(hostile).collect()]
    assert sorted(lines, key=lambda r: r["id"]) == rows


def test_sql_text_loads_with_foreign_keys(spark, store, scratch, ts):
    store.batch(ts(), seed=1, counts={"yards": 620, "cranes": 1100, "crews": 3, "lifts": 10})
    path = scratch("bundle")
    manifest = export.write_bundle(store.tables, store.data, store.log, path, fmt="sql")
    assert manifest["load_order"] == ["yards", "cranes", "crews", "lifts"]
    assert [f["rows"] for f in manifest["files"]] == [620, 1100, 3, 10]
    db = sqlite3.connect(":memory:")
    db.execute("PRAGMA foreign_keys = ON")
    for name in manifest["load_order"]:
        table = store.tables[name]
        columns = ", ".join(
            c + (" PRIMARY KEY" if c == table.pk else f" REFERENCES {table.refs[c]}" if c in table.refs else "")
            for c in table.columns)
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executescript(read_parts(f"{path}/{name}.sql"))
        assert db.execute(f"SELECT count(*) FROM {name}").fetchone()[0] == store.data[name].count()
    assert db.execute("PRAGMA foreign_key_check").fetchall() == []


def test_statements_hold_500_rows(spark):
    df = spark.range(1201).select(F.format_string("%05d", "id").alias("id"), F.lit(HOSTILE).alias("order"))
    out = export.sql_statements(df, "select", "id").orderBy("statement_no").collect()
    assert [r.n_rows for r in out] == [500, 500, 201]
    assert out[0].statement.startswith('INSERT INTO "select" (id, "order") VALUES\n(\'00000\', \'5" nails, 7\'\' boards')


def test_delta_equals_feed_and_catches_up(spark, store, scratch, ts):
    from tidemark.operators.feed import replay

    store.batch(ts(), seed=1)
    snap = export.export_table(store.tables["yards"], store.data["yards"], store.log, scratch("s"), "ndjson",
                               include_deleted=True)
    old = store.data["yards"]
    store.changes(ts(), seed=2, entities=["yards"], inserts=4, updates=6, deletes=3)
    path = scratch("d")
    done = export.export_table(store.tables["yards"], store.data["yards"], store.log, path, "ndjson",
                               since=snap.to_cursor)
    assert (snap.rows, snap.kind, done.rows, done.kind, done.from_cursor, done.to_cursor) == (
        36, "snapshot", 13, "changes", 36, 49)
    lines = [json.loads(line) for line in read_parts(path).splitlines()]
    assert [r["op"] for r in lines] == ["insert"] * 4 + ["update"] * 6 + ["delete"] * 3
    assert [r["version"] for r in lines] == list(range(37, 50))
    shape = f"op string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in store.tables['yards'].schema.fields)}"
    changes = spark.read.schema(shape).json(path)
    got = {tuple(r) for r in replay(old, changes, "yard_id").select("yard_id", "keeper", "version").collect()}
    live = store.data["yards"].filter("closed IS NULL").select("yard_id", "keeper", "version")
    assert got == {tuple(r) for r in live.collect()}


def test_refused_exports(store, scratch, ts):
    store.batch(ts(), seed=1)
    table, rows = store.tables["yards"], store.data["yards"]
    with pytest.raises(CursorAhead):
        export.export_table(table, rows, store.log, scratch(), "csv", since=37)
    for kw, code in (({"fmt": "xml"}, "invalid_format"), ({"dialect": "oracle"}, "invalid_dialect"),
                     ({"fmt": "sql", "since": 1}, "unsupported_format")):
        with pytest.raises(ValueError, match=code):
            export.export_table(table, rows, store.log, scratch(), **kw)
    with pytest.raises(ValueError, match="unknown_entity"):
        export.write_bundle(store.tables, store.data, store.log, scratch(), entities=["nope"])
    with pytest.raises(ValueError, match="since_not_targeted"):
        export.write_bundle(store.tables, store.data, store.log, scratch(), entities=["cranes"], since={"yards": 1})


def test_log_partitions_are_pruned(spark, store, scratch, ts):
    store.batch(ts(), seed=1)
    path = scratch("log")
    tables.append_log(store.log, path)
    plan = tables.read_log(spark, path).filter("entity = 'cranes' AND version > 10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity" in plan and "GreaterThan(version,10)" in plan
    assert tables.read_log(spark, path).filter("entity = 'cranes' AND version > 10").count() == 54


def test_a_column_of_nothing_keeps_its_rows(spark, scratch):
    df = spark.createDataFrame([("a",), (None,), ("",), ("b",)], "note string")
    path = scratch("one")
    export.write_csv(df.coalesce(1), path)
    assert list(csv.reader(io.StringIO(read_parts(path)))) == [["note"], ["a"], [""], [""], ["b"]]
    assert [r.line for r in export.csv_lines(df).collect()] == ["a", '""', '""', "b"]
