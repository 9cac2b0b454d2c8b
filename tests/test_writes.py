"""The write contract: contiguous versions, exact counts, disjoint samples, repeatable seeds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stores import Store, site_tables, empty_log, empty_rows
from tidemark.operators import batches, bulk, generate, validation
from tidemark.schema import declare


def dangling(store):
    out = 0
    for name, table in store.tables.items():
        for ref, parent in table.refs.items():
            out += validation.dangling_refs(store.data[name], ref, store.data[parent], store.tables[parent].pk).count()
    return out


def test_append_gives_contiguous_versions_and_sound_refs(store, ts):
    stats = store.batch(ts(), seed=1)
    assert {n: s["inserted"] for n, s in stats.items()} == {"yards": 36, "cranes": 64, "crews": 17, "lifts": 90}
    assert store.versions("cranes") == list(range(1, 65))
    again = store.batch(ts(), seed=2, entities=["cranes"], count=7)
    assert (again["cranes"]["first_version"], again["cranes"]["last_version"]) == (65, 71)
    assert store.versions("cranes") == list(range(1, 72))
    assert store.data["cranes"].count() == 71 and dangling(store) == 0


def test_same_seed_same_rows(spark, scratch, ts):
    def rows():
        store = Store(spark, site_tables(), scratch)
        store.batch(ts(), seed=5)
        return {n: sorted(map(str, df.drop("opened", "checked").collect())) for n, df in store.data.items()}

    assert rows() == rows()


def test_replace_leaves_tombstones_and_climbs(store, ts):
    store.batch(ts(), seed=1)
    store.changes(ts(), seed=2, entities=["yards"], inserts=0, updates=0, deletes=10)
    before = store.versions("yards")[-1]
    stats = store.batch(ts(), mode="replace", entities=["yards"], count=4, seed=3, confirm=True)
    assert set(stats) == {"yards", "cranes", "crews", "lifts"}
    assert stats["yards"]["deleted"] == 36  # soft-deleted rows get a tombstone too
    assert store.versions("yards") == list(range(1, before + 36 + 4 + 1))
    assert store.data["yards"].count() == 4 and dangling(store) == 0


def test_reset_restarts_at_one_and_keeps_other_history(store, ts):
    store.batch(ts(), seed=1)
    store.batch(ts(), mode="reset", entities=["cranes"], count=6, seed=3, confirm=True)
    assert store.versions("cranes") == list(range(1, 7))
    assert store.versions("yards") == list(range(1, 37))


def test_batch_requests_refused(store, ts):
    def refused(code, **kw):
        with pytest.raises(ValueError, match=code):
            store.batch(ts(), **kw)

    refused("invalid_mode", mode="upsert")
    refused("unknown_entity", entities=["nope"])
    refused("invalid_count", count=-1)
    refused("invalid_count", count=501, row_limit=500)
    refused("counts_not_targeted", entities=["yards"], counts={"cranes": 3})
    refused("confirmation_required", mode="replace")
    refused("missing_parent_rows", entities=["cranes"], count=3)
    assert store.log.count() == 0


def test_replacing_parents_by_nothing_is_refused_whole(store, ts):
    store.batch(ts(), seed=1)
    with pytest.raises(generate.MissingParents):
        store.batch(ts(), mode="replace", counts={"yards": 0, "cranes": 2, "crews": 0, "lifts": 0},
                    entities=["yards"], confirm=True)
    assert store.data["yards"].count() == 36


def test_reused_seed_collides(store, ts):
    store.batch(ts(), seed=1)
    with pytest.raises(generate.DuplicateKeys, match="duplicate_primary_key"):
        store.batch(ts(), seed=1, entities=["yards"], count=10)


def test_change_batch_counts_and_order(store, ts):
    store.batch(ts(), seed=1)
    before = {r.yard_id: r for r in store.data["yards"].collect()}
    stats, notes = store.changes(ts("2024-06-02 00:00:00"), seed=9, entities=["yards"],
                                 inserts=5, updates=7, deletes=3)
    s = stats["yards"]
    assert (s["inserted"], s["updated"], s["deleted"], s["live_rows"], s["total_rows"]) == (5, 7, 3, 38, 41)
    assert (s["first_version"], s["last_version"]) == (37, 51) and notes == []
    ops = [r.op for r in store.log.filter("entity = 'yards' AND version > 36").orderBy("version").collect()]
    assert ops == ["insert"] * 5 + ["update"] * 7 + ["delete"] * 3
    after = {r.yard_id: r for r in store.data["yards"].collect()}
    moved = [k for k in before if after[k].version != before[k].version]
    gone = [k for k in moved if after[k].closed is not None]
    updated = [k for k in moved if after[k].closed is None]
    assert len(gone) == 3 and len(updated) == 7
    assert all(after[k].opened == before[k].opened for k in before)
    assert all(after[k].checked != before[k].checked for k in updated)
    assert sum((after[k].keeper, after[k].berths) != (before[k].keeper, before[k].berths) for k in updated) >= 6
    assert all(after[k].keeper == before[k].keeper for k in gone)


def test_updates_keep_references(store, ts):
    store.batch(ts(), seed=1)
    before = {r.crane_id: r.yard_id for r in store.data["cranes"].collect()}
    store.changes(ts(), seed=2, entities=["cranes"], inserts=0, updates=64, deletes=0)
    after = {r.crane_id: r.yard_id for r in store.data["cranes"].collect()}
    assert before == after


def test_clamping_leaves_notes(store, ts):
    store.batch(ts(), seed=1)
    stats, notes = store.changes(ts(), seed=2, entities=["yards"], inserts=0, updates=30, deletes=50)
    assert (stats["yards"]["updated"], stats["yards"]["deleted"]) == (30, 6)
    assert len(notes) == 1 and "yards: asked to delete 50" in notes[0]


def test_default_sizes(store, ts):
    store.batch(ts(), seed=1, counts={"yards": 200})
    s = store.changes(ts(), seed=2, entities=["yards"])[0]["yards"]
    assert 2 <= s["inserted"] <= 6 and s["updated"] == 8 and s["deleted"] == 3


def test_new_children_point_at_live_parents(store, ts):
    store.batch(ts(), seed=1)
    store.changes(ts(), seed=4, entities=["yards", "cranes"], inserts=20, updates=0, deletes=15)
    old = {r.pk_value for r in store.log.filter("entity = 'cranes' AND op = 'insert' AND version <= 64").collect()}
    live = {r.yard_id for r in store.data["yards"].filter("closed IS NULL").collect()}
    new = [r for r in store.data["cranes"].collect() if r.crane_id not in old]
    assert len(new) == 20 and all(r.yard_id in live for r in new)


def test_repeated_ticks_never_touch_deleted_rows(spark, store, ts):
    store.batch(ts(), seed=1, counts={"yards": 100})
    store.changes(ts(), seed=2, entities=["yards"], inserts=0, updates=0, deletes=60)
    dead = {r.yard_id: r.version for r in store.data["yards"].filter("closed IS NOT NULL").collect()}
    assert len(dead) == 60
    for i in range(4):
        store.changes(ts(), seed=10 + i, entities=["yards"])
    now = {r.yard_id: r.version for r in store.data["yards"].collect()}
    assert all(now[k] == v for k, v in dead.items())


def test_no_soft_delete_field_no_deletes(spark, ts):
    plain = declare({"entity": "plain", "fields": {"id": {"type": "uuid", "primary_key": True}, "v": {"type": "int"}}})
    rows, log = empty_rows(spark, plain), empty_log(spark)
    with pytest.raises(ValueError, match="not_supported"):
        batches.change_batch(spark, plain, rows, log, 1, ts(), deletes=1)
    with pytest.raises(ValueError, match="not_supported"):
        bulk.delete_rows(plain, rows, log, spark.createDataFrame([], "row_pos bigint, key string"), ts())


def test_tick_respects_the_row_cap_and_records_failure(spark, ts):
    table = declare({
        "entity": "t", "fields": {"id": {"type": "uuid", "primary_key": True}},
        "update_schedule": {"new_records": [8, 8]}}, max_rows=23)
    rows = generate.generate(spark, table, 20, 1, ts()).withColumn("version", F.col("i") + 1).drop("i")
    runs = batches.run_record(spark, 7, "t", ts(), {"inserted": 20})
    record = batches.recorded(spark, runs, "t", ts(), lambda: batches.tick(spark, table, rows, empty_log(spark), 2, ts()).stats)
    assert (record.first().run_id, record.first().status, record.first().rows_inserted) == (8, "success", 3)
    with pytest.raises(ValueError, match="quota_exceeded"):
        batches.change_batch(spark, table, rows, empty_log(spark), 2, ts(), inserts=4, cap=table.max_rows)
    child = declare({"entity": "c", "fields": {
        "id": {"type": "uuid", "primary_key": True}, "t": {"type": "ref", "ref_entity": "t"}},
        "update_schedule": {"new_records": [1, 1]}}, siblings=["t"])
    record = batches.recorded(spark, runs, "c", ts(), lambda: batches.tick(
        spark, child, empty_rows(spark, child), empty_log(spark), 2, ts(), {"t": (rows.limit(0), "id")}).stats)
    assert record.first().status == "failed"


def test_declared_caps_are_enforced(spark, scratch, ts):
    import dataclasses

    capped = site_tables() | {"yards": dataclasses.replace(site_tables()["yards"], max_rows=40)}
    store = Store(spark, capped, scratch)
    with pytest.raises(ValueError, match="quota_exceeded"):
        store.batch(ts(), seed=1, entities=["yards"], count=41)
    store.batch(ts(), seed=1, entities=["yards"], count=37)
    with pytest.raises(ValueError, match="quota_exceeded"):
        store.changes(ts(), seed=2, entities=["yards"], inserts=4, updates=0, deletes=0)
    for seed in (3, 4):
        store.changes(ts(), seed=seed, entities=["yards"])
    assert 39 <= store.data["yards"].count() <= 40


def exchanged_columns(df):
    """Column counts of the rows that the plan shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_few_changes_leave_a_big_table_where_it_lies(spark, ts):
    table = site_tables()["yards"]
    big = generate.generate(spark, table, 50_000, 1, ts()).withColumn("version", F.col("i") + 1).drop("i")
    log = empty_log(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    results = {}
    try:
        for limit in ("1m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            made = batches.change_batch(spark, table, big, log, 5, ts(), inserts=0, updates=20, deletes=5)
            if limit == "1m":
                assert not [x for x in exchanged_columns(made.rows) if "yard_id" in x]
            results[limit] = sorted(map(str, made.rows.filter("version > 50000").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert results["1m"] == results["-1"] and len(results["1m"]) == 25


def test_new_keys_may_not_repeat(spark):
    new = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    with pytest.raises(generate.DuplicateKeys, match="two generated keys"):
        generate.check_new_keys(new, spark.createDataFrame([("z",)], "id string"), "id", 3)


def test_seeding_only_fills_what_is_empty(spark, ts):
    tables = site_tables()
    data = {n: empty_rows(spark, t) for n, t in tables.items()}
    once = generate.seed_missing(spark, tables, data, 3, ts())
    assert {n: df.count() for n, df in once.items()} == {"yards": 36, "cranes": 64, "crews": 17, "lifts": 90}
    twice = generate.seed_missing(spark, tables, once, 99, ts())
    assert all(twice[n] is once[n] for n in tables)


# ------------------------------------------------------------------ bulk payloads
@pytest.fixture
def site(spark, store, ts):
    store.batch(ts(), seed=1)
    return store


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_pos bigint, payload string")


def parents(store):
    return {"yards": (store.data["yards"], "yard_id")}


def test_bulk_create_keeps_what_is_given(spark, site, ts):
    known = site.data["yards"].first().yard_id
    made = bulk.create_rows(
        spark, site.tables["cranes"], site.data["cranes"], site.log,
        payloads(spark, f'{{"yard_id": "{known}", "reach": 7.5}}', "{}"), 77, ts(), parents(site))
    new = made.rows.filter("version > 64").orderBy("version").collect()
    assert (new[0].yard_id, new[0].reach) == (known, 7.5)
    assert new[1].yard_id is not None and 0.25 <= new[1].reach <= 80
    assert [r.version for r in new] == [65, 66] and made.log.count() == 2


def test_bulk_create_takes_any_unique_positions(spark, site, ts):
    given = spark.createDataFrame([(1 << 40, '{"reach": 1}'), (10, '{"reach": 2}'), (25, '{"reach": 3}')], "row_pos bigint, payload string")
    made = bulk.create_rows(spark, site.tables["cranes"], site.data["cranes"], site.log, given, 77, ts(), parents(site))
    new = made.rows.filter("version > 64").orderBy("version").collect()
    assert [(r.version, r.reach) for r in new] == [(65, 2.0), (66, 3.0), (67, 1.0)]
    assert len({r.crane_id for r in new}) == 3 and made.stats["last_version"] == 67
    assert sorted(r.version for r in made.log.collect()) == [65, 66, 67]
    with pytest.raises(bulk.InvalidBatch, match="repeated_position"):
        bulk.create_rows(spark, site.tables["cranes"], site.data["cranes"], site.log, given.union(given.limit(1)), 77, ts(), parents(site))


def test_bulk_create_is_all_or_nothing(spark, site, ts):
    with pytest.raises(bulk.InvalidBatch, match=r"unknown_field: rows\[2\]"):
        bulk.create_rows(spark, site.tables["cranes"], site.data["cranes"], site.log,
                         payloads(spark, '{"reach": 3}', '{"fuel": "diesel"}', '{"boom": "north"}'), 7, ts(), parents(site))


def test_bulk_create_respects_cap_and_row_limit(spark, site, ts):
    import dataclasses

    capped = dataclasses.replace(site.tables["cranes"], max_rows=65)
    with pytest.raises(bulk.InvalidBatch, match="quota_exceeded"):
        bulk.create_rows(spark, capped, site.data["cranes"], site.log, payloads(spark, "{}", "{}"), 7, ts(), parents(site))
    with pytest.raises(bulk.InvalidBatch, match="too_many_rows"):
        bulk.create_rows(spark, site.tables["cranes"], site.data["cranes"], site.log,
                         payloads(spark, "{}", "{}"), 7, ts(), parents(site), row_limit=1)


def test_bulk_update_merges_in_order(spark, site, ts):
    a, b = [r.crane_id for r in site.data["cranes"].orderBy("crane_id").limit(2).collect()]
    wanted = spark.createDataFrame([
        (0, a, '{"reach": 2.25}'), (1, b, '{"fuel": "hybrid"}'), (2, "missing", '{"reach": 1}'),
        (3, a, '{"fuel": "diesel"}'), (4, a, '{"reach": 6}'), (5, b, '{"version": 1}'),
    ], "row_pos bigint, key string, payload string")
    made, judged = bulk.update_rows(site.tables["cranes"], site.data["cranes"], site.log, wanted, ts(), parents(site))
    rows = {r.crane_id: r for r in made.rows.collect()}
    assert (rows[a].reach, rows[a].fuel, rows[a].version) == (6.0, "diesel", 68)
    assert (rows[b].fuel, rows[b].version) == ("hybrid", 66)
    assert [r.version for r in made.log.orderBy("version").collect()] == [65, 66, 67, 68]
    codes = {r.row_pos: r.error_code for r in judged.collect()}
    assert codes == {0: None, 1: None, 2: "not_found", 3: None, 4: None, 5: "read_only_field"}


def test_deleting_twice_logs_twice(spark, site, ts):
    key = site.data["cranes"].first().crane_id
    wanted = spark.createDataFrame([(0, key), (1, "missing"), (2, key)], "row_pos bigint, key string")
    made, judged = bulk.delete_rows(site.tables["cranes"], site.data["cranes"], site.log, wanted, ts())
    assert made.log.count() == 2 and judged.filter("error_code = 'not_found'").count() == 1
    row = made.rows.filter(F.col("crane_id") == key).first()
    assert row.scrapped is not None and row.version == 66


@pytest.mark.parametrize("positions, code", [((5, None), "missing_position"), ((5, 5), "repeated_position")])
def test_updates_and_deletes_need_positions_that_order_them(spark, site, ts, positions, code):
    a, b = [r.crane_id for r in site.data["cranes"].orderBy("crane_id").limit(2).collect()]
    updates = spark.createDataFrame([(positions[0], a, '{"reach": 2}'), (positions[1], b, '{"reach": 3}')], "row_pos bigint, key string, payload string")
    with pytest.raises(bulk.InvalidBatch, match=code):
        bulk.update_rows(site.tables["cranes"], site.data["cranes"], site.log, updates, ts(), parents(site))
    with pytest.raises(bulk.InvalidBatch, match=code):
        bulk.delete_rows(site.tables["cranes"], site.data["cranes"], site.log, updates.drop("payload"), ts())


def test_positions_may_be_sparse_and_large_changes_are_not_broadcast(spark, site, ts):
    keys = [r.crane_id for r in site.data["cranes"].orderBy("crane_id").collect()]
    places = [(i * 2654435761 % 64 - 32) << 50 for i in range(64)]  # far apart, below zero too
    text = "x" * 300_000
    requests = spark.createDataFrame([(p, k, f'{{"note": "{text if k == keys[0] else p}"}}') for p, k in zip(places, keys)], "row_pos bigint, key string, payload string")
    made, judged = bulk.update_rows(site.tables["cranes"], site.data["cranes"], site.log, requests, ts(), parents(site))
    assert judged.filter("error_code IS NOT NULL").count() == 0
    got = [r.crane_id for r in made.rows.orderBy("version").collect()]
    assert got == [k for _, k in sorted(zip(places, keys))]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # 64 rows of keys fit, their texts do not
        last = judged.select("key")
        assert bulk._beside(site.data["cranes"], last, judged) is last
        assert bulk._beside(site.data["cranes"], last, judged.filter(F.length("payload") < 1000)) is not last
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_an_index_refuses_null_keys_and_takes_sparse_ones(spark):
    from tidemark.operators import ranking

    with pytest.raises(Exception, match="v is null"):
        ranking.index_by_integer(spark.createDataFrame([(1,), (None,)], "v bigint"), "v").collect()
    values = sorted((i * 6364136223846793005 % (1 << 63)) - (1 << 62) for i in range(6000))
    got = ranking.index_unique(spark.createDataFrame([(v,) for v in values], "v bigint"), "v").collect()
    assert sorted((r.idx, r.v) for r in got) == list(enumerate(values, 1))


CELLAR = {
    "entity": "casks",
    "fields": {"cask_id": {"type": "uuid", "primary_key": True}, "yard": {"type": "ref", "ref_entity": "yards"},
               "litres": {"type": "float"}, "wood": {"type": "enum", "values": ["oak", "acacia"]},
               "label": {"type": "string", "nullable": True}, "filled": {"type": "timestamp"}, "rings": {"type": "int"},
               "sealed": {"type": "bool"}, "emptied": {"type": "timestamp", "auto": "soft_delete"}},
}

# what is wrong with a payload, and payloads for which it is
MATRIX = {
    "unknown_field": ['{"cork": "wax"}', '{"cork": null, "litres": "n/a"}'],
    "read_only_field": ['{"cask_id": "C-9"}', '{"version": 0}', '{"emptied": "2003-03-03T03:03:03Z"}'],
    "invalid_value": [
        '{"litres": "225"}', '{"litres": false}', '{"litres": null}', '{"litres": "225", "cork": 1}', '{"wood": "pine"}', '{"yard": 12}',
        '{"yard": null}', '{"filled": "after the frost"}', '{"rings": 40.0}', '{"rings": false}', '{"sealed": "yes"}', '{"sealed": 0}'],
    "invalid_reference": ['{"yard": "nobody"}'],
    "invalid_json": ['["oak"]', '{"wood": ', "", "12"],
    None: ['{}', '{"yard": "y1"}', '{"label": null, "litres": 225}', '{"filled": "1987-10-16T05:30:00+01:00"}', '{"rings": 40, "sealed": true}',
           '{"litres": 2.25e2}', '{"label": "5\\" staves, \'old\'\\t"}'],
}


def test_payload_matrix(spark):
    table = declare(CELLAR, siblings=["yards"])
    keys = spark.createDataFrame([("y1",)], "id string")
    want = {text: code for code, texts in MATRIX.items() for text in texts}
    checked = validation.validate(payloads(spark, *want), table, {"yards": (keys, "id")})
    assert {r.payload: r.error_code for r in checked.collect()} == want
    assert checked.filter("(message IS NULL) <> (error_code IS NULL)").count() == 0
