from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feed, graph, tenancy, validation
from tidemark.streaming import feeds

LOG = "entity string, pk_value string, op string, version bigint"


def make_log(spark, n=50, entity="t"):
    ops = ["insert", "update", "update", "delete"]
    rows = [(entity, f"k{i % 7}", ops[i % 4], i + 1) for i in range(n)]
    return spark.createDataFrame(rows, LOG).withColumn(
        "changed_at", F.timestamp_add("MINUTE", F.col("version"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))


def test_polling_equals_draining(spark):
    log, seen, cursor, pages = make_log(spark), [], 0, 0
    while True:
        page = feed.feed_page(log, "t", cursor, 20).collect()
        facts = feed.page_facts(log, "t", cursor, 20).first()
        seen += [r.version for r in page]
        cursor, pages = facts.next_cursor, pages + 1
        if not facts.has_more:
            break
    assert seen == list(range(1, 51)) and pages == 3
    drained = feed.drain(log, 20).orderBy("page").collect()
    assert [(r.page, r.next_cursor, r.n_changes) for r in drained] == [(0, 20, 20), (1, 40, 20), (2, 50, 10)]


def test_full_last_page_says_there_is_more(spark):
    facts = feed.page_facts(make_log(spark, 40), "t", 20, 20).first()
    assert (facts.next_cursor, facts.has_more) == (40, True)
    facts = feed.page_facts(make_log(spark, 40), "t", 40, 20).first()
    assert (facts.next_cursor, facts.has_more) == (40, False)


def test_stale_cursor_raises(spark):
    current = spark.createDataFrame([("k1", 1, 5)], "id string, v int, version bigint")
    with pytest.raises(feed.CursorAhead):
        feed.read_changes(make_log(spark), current, "t", "id", since=51)
    page, facts = feed.read_changes(make_log(spark), current, "t", "id", since=45)
    assert page.count() == 5 and facts.first().next_cursor == 50


def test_wiped_rows_leave_only_their_key(spark):
    current = spark.createDataFrame([("k1", 10, 5)], "id string, v int, version bigint")
    rows = feed.enrich(make_log(spark), current, "id").collect()
    assert all((r.v == 10) == (r.id == "k1") for r in rows) and len(rows) == 50
    assert sorted(r.version for r in rows) == list(range(1, 51))


def test_replay_is_idempotent(spark):
    log = make_log(spark)
    current = spark.createDataFrame([(f"k{i}", i * 10, 1) for i in range(7)], "id string, v int, version bigint")
    snapshot = spark.createDataFrame([(f"k{i}", -1, 1) for i in range(9)], "id string, v int, version bigint")
    changes = feed.delta(log, current, "t", "id", 10, 50)
    once = feed.replay(snapshot, changes, "id")
    twice = feed.replay(once, changes.unionByName(changes), "id")
    expected = {"k7": -1, "k8": -1}
    for i in range(7):
        last = max((r for r in log.collect() if r.pk_value == f"k{i}"), key=lambda r: r.version)
        if last.op != "delete":
            expected[f"k{i}"] = i * 10
    assert {r.id: r.v for r in once.collect()} == expected == {r.id: r.v for r in twice.collect()}


def test_replay_keeps_a_reset_table_in_step(spark):
    snapshot = spark.createDataFrame([("a", 1, 1)], "id string, v int, version bigint")
    changes = spark.createDataFrame([("delete", "a", None, 2), ("insert", "b", 5, 3), ("insert", "a", 7, 4)],
                                    "op string, id string, v int, version bigint")
    assert {r.id: r.v for r in feed.replay(snapshot, changes, "id").collect()} == {"a": 7, "b": 5}


def test_audit_sees_gaps_across_buckets(spark):
    versions = [v for v in range(1, 200) if v not in (64, 65, 130)] + [7, 7]
    log = spark.createDataFrame([("t", "k", "insert", v) for v in versions], LOG)
    row = validation.version_audit(log, bits=5).first()
    assert (row.n_gaps, row.n_duplicates, row.is_contiguous) == (2, 2, False)
    assert validation.version_audit(make_log(spark), bits=3).first().is_contiguous


# ---------------------------------------------------------------------- graph
def test_levels_cycles_and_closures(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")],
                                  "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexyz"], "node string")
    got = {r.node: r.level for r in graph.levels(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "x": None, "y": None, "z": None}
    assert {(r.child, r.parent) for r in graph.stuck_edges(edges).collect()} == {("x", "y"), ("y", "x"), ("z", "x")}
    seeds = nodes.filter("node = 'b'")
    assert {r.node for r in graph.closure(edges, seeds).collect()} == {"b", "c", "d"}
    assert {r.node for r in graph.closure(edges, nodes.filter("node = 'd'"), "parents").collect()} == set("abcd")
    assert {r.node for r in graph.closure(edges, nodes.filter("node = 'x'")).collect()} == {"x", "y", "z"}


def test_levels_with_hot_parents(spark, no_broadcast):
    edges = spark.createDataFrame([(f"c{i}", "root") for i in range(300)] + [("leaf", "c7")], "child string, parent string")
    nodes = spark.createDataFrame([("root",), ("leaf",)] + [(f"c{i}",) for i in range(300)], "node string")
    got = {r.node: r.level for r in graph.levels(nodes, edges).collect()}
    assert (got["root"], got["c5"], got["leaf"]) == (0, 1, 2)


# ------------------------------------------------------------------- throttle
def brute_force(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t > last + gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("segment_minutes", [7, 60])
def test_throttle_equals_the_sequential_rule(spark, segment_minutes):
    import random

    rng = random.Random(4)
    uses = {"hot": sorted(rng.uniform(0, 36000) for _ in range(4000)),       # never pauses
            "cold": sorted(rng.uniform(0, 36000) for _ in range(40)),
            "even": [300.0 * i for i in range(30)],                          # exactly the gap apart
            "one": [5.0], "same": [9.0] * 20}
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    rows = [(k, int(t * 1_000_000)) for k, ts in uses.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, us bigint").select(
        "k", F.timestamp_add("MICROSECOND", F.col("us"), start).alias("at")).repartition(5)
    got: dict[str, list] = {}
    back = tenancy.throttled_uses(df, "k", "at", segment_minutes=segment_minutes)
    for r in back.select("k", F.timestamp_diff("MICROSECOND", start, F.col("at")).alias("us")).collect():
        got.setdefault(r.k, []).append(r.us)
    for k in uses:
        assert sorted(got[k]) == brute_force([u for kk, u in rows if kk == k], 300_000_000), k


# ------------------------------------------------------------------ streaming
def test_consumer_resumes_without_loss_or_repeats(spark, scratch):
    path, out, cursor = scratch("log"), scratch("out"), scratch("cursor")
    log = make_log(spark)
    schema = log.schema
    log.filter("version <= 20").write.parquet(path)
    feeds.run_to_end(feeds.follow(spark, path, schema), out, cursor)
    assert spark.read.parquet(out).count() == 20
    log.filter("version > 20").write.mode("append").parquet(path)
    feeds.run_to_end(feeds.follow(spark, path, schema), out, cursor)
    assert sorted(r.version for r in spark.read.parquet(out).collect()) == list(range(1, 51))


def test_streamed_states_equal_the_batch_result(spark, scratch):
    path, out, cursor = scratch("log"), scratch("out"), scratch("cursor")
    log = make_log(spark)
    for low in (0, 17, 34):
        log.filter((F.col("version") > low) & (F.col("version") <= low + 17)).write.mode("append").parquet(path)
        stream = feeds.key_states(feeds.follow(spark, path, log.schema))
        feeds.update_to_end(stream, out, cursor)
    got = feeds.current_states(feeds.read_sink(spark, out, stream)).collect()
    want = feed.last_change(log, "entity", "pk_value").collect()
    assert sorted((r.pk_value, r.version, r.op) for r in got) == sorted((r.pk_value, r.version, r.op) for r in want)


def test_streamed_throttle_keeps_state_between_runs(spark, scratch):
    path, out, cursor = scratch("uses"), scratch("out"), scratch("cursor")
    log = make_log(spark, 60).select("entity", "changed_at")  # one use a minute
    for low, high in ((0, 25), (25, 60)):
        part = log.filter((F.minute("changed_at") >= low) & (F.minute("changed_at") < high) & (F.hour("changed_at") == 0))
        part.write.mode("append").parquet(path)
        feeds.run_to_end(feeds.refreshed_uses(feeds.follow(spark, path, log.schema), "entity", "changed_at"), out, cursor)
    got = sorted(r.m for r in spark.read.parquet(out).select(F.minute("changed_at").alias("m")).collect())
    assert got == [1, 7, 13, 19, 25, 31, 37, 43, 49, 55]


def test_chains_close_in_few_rounds(spark, monkeypatch):
    from tidemark.operators import graph

    rounds = []
    stored = graph.pin
    monkeypatch.setattr(graph, "pin", lambda df, label: rounds.append(label) or stored(df, label))
    chain = spark.range(4096).select((F.col("id") + 1).cast("string").alias("child"), F.col("id").cast("string").alias("parent"))
    seeds = spark.createDataFrame([("0",), ("0",), ("4000",)], "node string")
    got = {r.node: r.steps for r in graph.closure(chain, seeds).collect()}
    assert len(got) == 4097 and got["3999"] == 3999 and got["4096"] == 96 and rounds.count("found") <= 16
    mixed = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d")], "child string, parent string")
    assert {r.node: r.steps for r in graph.closure(mixed, seeds.limit(0).union(spark.createDataFrame([("a",)], "n string"))).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def ladder(spark, n):
    """Each node needs the one below it and the one two below it."""
    ids = spark.range(1, n + 1).select(F.col("id").cast("int").alias("child"))
    return ids.select("child", F.explode(F.array(F.col("child") - 1, F.col("child") - 2)).alias("parent")).where("parent >= 0")


def test_deep_trees_settle_in_few_rounds(spark, monkeypatch):
    from tidemark.operators import graph

    rounds = []
    stored = graph.pin
    monkeypatch.setattr(graph, "pin", lambda df, label: rounds.append(label) or stored(df, label))
    ids = spark.range(1, 1025).select(F.col("id").cast("int").alias("child"))
    edges = ids.select("child", (F.col("child") - 1).alias("parent")).union(ids.select(F.col("child") + 5000, "child"))  # a leaf at each
    nodes = edges.select(F.col("child").alias("node")).union(spark.createDataFrame([(0,), (9999,)], "node int"))
    got = {r.node: r.level for r in graph.levels(nodes, edges).collect()}
    assert got == {**{i: i for i in range(1025)}, **{5000 + i: i + 1 for i in range(1, 1025)}, 9999: 0} and rounds.count("edges") <= 13
    rounds.clear()
    got = {r.node: r.steps for r in graph.closure(edges, nodes.where("node = 0")).collect()}
    assert len(got) == 2049 and got[1024] == 1024 and got[6024] == 1025 and rounds.count("found") + rounds.count("frontier") <= 20


def test_deep_graphs_beyond_the_budget(spark, monkeypatch):
    from tidemark.operators import graph

    monkeypatch.setattr(graph, "LEAST_BUDGET", 0)
    edges = ladder(spark, 12)
    nodes = spark.range(13).select(F.col("id").cast("int").alias("node"))
    assert {r.node: r.level for r in graph.levels(nodes, edges).collect()} == {i: i for i in range(13)}
    assert {r.node: r.steps for r in graph.closure(edges, nodes.where("node = 0")).collect()} == {i: (i + 1) // 2 for i in range(13)}


def test_cycles_and_what_leads_to_them(spark):
    from random import Random

    from tidemark.operators import graph

    draw = Random(1)
    pairs = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(12)} | {(40 + i, 40 + (i + 1) % 12) for i in range(12)} | {(3, 40), (45, 2)})
    up = {}
    for child, parent in pairs:
        up.setdefault(child, set()).add(parent)

    def above(node):
        seen, left = set(), [node]
        while left:
            fresh = up.get(left.pop(), set()) - seen
            seen |= fresh
            left += fresh
        return seen

    reach = {n: above(n) for n in range(80)}
    cycle = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}
    stuck = {n for n in reach if n in cycle or reach[n] & cycle.keys()}
    edges = spark.createDataFrame([*pairs, (3, None), (None, 3)], "child int, parent int")
    got = {(r.child, r.parent): r.cycle for r in graph.stuck_parts(edges).collect()}
    assert got == {(c, p): cycle.get(c) if cycle.get(c) == cycle.get(p) else None for c, p in pairs if p in stuck}
