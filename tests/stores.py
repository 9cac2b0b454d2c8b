"""Declared tables and a caller of the write operators, for the tests of the write, feed and export contracts."""

from __future__ import annotations

from tidemark.schema import declare

SOFT = {"type": "timestamp", "auto": "soft_delete"}


def site_tables():
    """A diamond: lifts need a crane and a crew, both of one yard. Two enums in one table, a reference that may be
    null, and a table without soft-delete (crews)."""
    yards = declare({
        "entity": "yards", "seed": {"initial_count": 36},
        "update_schedule": {"cadence": "weekly", "new_records": [2, 6], "mutate_existing_pct": 4, "soft_delete_pct": 2},
        "fields": {"closed": SOFT, "checked": {"type": "timestamp", "auto": "updated"},
                   "berths": {"type": "int", "min": 1, "max": 900},
                   "surface": {"type": "enum", "values": ["gravel", "asphalt", "slab", "sand", "rail"]},
                   "tide": {"type": "enum", "values": ["open", "locked"]},
                   "keeper": {"type": "string", "key_label": "full_name"},
                   "yard_id": {"type": "uuid", "primary_key": True},
                   "opened": {"type": "timestamp", "auto": "created"}}})
    cranes = declare({
        "entity": "cranes", "seed": {"initial_count": 64},
        "update_schedule": {"cadence": "daily", "new_records": [1, 9], "mutate_existing_pct": 12, "soft_delete_pct": 4},
        "fields": {"fuel": {"type": "enum", "values": ["mains", "diesel", "hybrid"]},
                   "reach": {"type": "float", "min": 0.25, "max": 80},
                   "note": {"type": "string", "nullable": True},
                   "crane_id": {"type": "uuid", "primary_key": True},
                   "yard_id": {"type": "ref", "ref_entity": "yards"},
                   "scrapped": SOFT}},
        siblings=["yards"])
    crews = declare({
        "entity": "crews", "seed": {"initial_count": 17},
        "fields": {"crew_id": {"type": "uuid", "primary_key": True},
                   "home_yard": {"type": "ref", "ref_entity": "yards", "nullable": True},
                   "heads": {"type": "int", "min": 2, "max": 12}, "hired": {"type": "timestamp"}}},
        siblings=["yards"])
    lifts = declare({
        "entity": "lifts", "seed": {"initial_count": 90},
        "update_schedule": {"cadence": "hourly", "new_records": [3, 4], "mutate_existing_pct": 2.5, "soft_delete_pct": 0.5},
        "fields": {"at_night": {"type": "bool"}, "crew_id": {"type": "ref", "ref_entity": "crews"},
                   "crane_id": {"type": "ref", "ref_entity": "cranes"},
                   "tonnes": {"type": "float", "min": 0, "max": 4000},
                   "lift_id": {"type": "uuid", "primary_key": True}, "void_at": SOFT}},
        siblings=["yards", "cranes", "crews"])
    return {t.name: t for t in (yards, cranes, crews, lifts)}


def empty_log(spark):
    return spark.createDataFrame(
        [], "entity string, pk_value string, op string, version bigint, changed_at timestamp_ntz")


def empty_rows(spark, table):
    return spark.createDataFrame([], table.schema)


class Store:
    """A caller of the write operators: writes each result to a fresh path, then publishes it."""

    def __init__(self, spark, tables, scratch):
        self.spark, self.tables, self.scratch = spark, tables, scratch
        self.data = {n: empty_rows(spark, t) for n, t in tables.items()}
        self.log = empty_log(spark)

    def publish(self, data, log):
        def stored(df, label):
            path = self.scratch(label)
            df.coalesce(2).write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        fresh = {n: stored(df, n) if df is not self.data[n] else df for n, df in data.items()}
        self.log, self.data = stored(log, "log"), fresh

    def batch(self, batch_ts, **kw):
        from tidemark.operators.batches import run_batch

        data, log, stats = run_batch(self.spark, self.tables, self.data, self.log, batch_ts, **kw)
        self.publish(data, log)
        return {s["entity"]: s for s in stats}

    def changes(self, batch_ts, **kw):
        from tidemark.operators.batches import run_changes

        data, log, stats, notes = run_changes(self.spark, self.tables, self.data, self.log, batch_ts, **kw)
        self.publish(data, log)
        return {s["entity"]: s for s in stats}, notes

    def versions(self, entity):
        return sorted(r.version for r in self.log.filter(f"entity = '{entity}'").select("version").collect())
