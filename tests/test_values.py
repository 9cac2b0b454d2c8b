from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import draws, text


def test_ranges_and_shapes(spark):
    i = F.col("id")
    rows = spark.range(5000).select(
        draws.uniform_int(draws.draw(1, "t", "a", i), 1, 5).alias("n"),
        draws.uniform_cents(draws.draw(1, "t", "b", i), 10, 500).alias("x"),
        draws.uuid_text(draws.digest(1, "t", "c", i)).alias("u"),
        draws.letters(draws.draw(1, "t", "d", i)).alias("s"),
        draws.coin(draws.draw(1, "t", "e", i)).alias("b")).collect()
    assert {r.n for r in rows} == {1, 2, 3, 4, 5}
    assert all(10 <= r.x <= 500 and round(r.x, 2) == r.x for r in rows)
    shape = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    assert all(shape.match(r.u) for r in rows) and len({r.u for r in rows}) == 5000
    assert all(re.match("^[a-z]{8}$", r.s) for r in rows)
    assert 2000 < sum(r.b for r in rows) < 3000


def test_draws_do_not_depend_on_partitions(spark):
    value = draws.draw(3, "t", "f", F.col("id"))
    one = {r.id: r.v for r in spark.range(0, 500, 1, 1).select("id", value.alias("v")).collect()}
    many = {r.id: r.v for r in spark.range(0, 500, 1, 17).select("id", value.alias("v")).collect()}
    assert one == many


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_equal_looking_names(spark):
    same = ["Alice Almeida", "  alice   almeida ", "ALICE\tALMEIDA", "﻿Alice Almeida", "Alice​ Almeida",
            "Ａlice Almeida", "Alice Almeida", "Al­ice Almeida", "‮Alice Almeida⁩"]
    assert set(_map(spark, same, text.name_key)) == {"alice almeida"}
    assert _map(spark, ["oﬃce", "Straße", None], text.name_key) == ["office", "strasse", None]
    assert len(set(_map(spark, ["Alice A", "Alice B", "AliceA"], text.name_key))) == 3


def test_iso_parsing(spark):
    texts = ["2026-01-31T12:00:00Z", "2026-01-31T12:00:00", "2026-01-31 12:00", "2026-01-31", "2026-01-31T12:00:00.25",
             "2026-01-31T12:00:00,25", "2026-01-31T12:00:00+05:30", "2026-01-31T12:00:00-0100", "last tuesday",
             "2026-02-30", "2026-01-31T25:00:00", "2026-13-01", "", None]
    got = _map(spark, texts, lambda c: text.iso_text(text.parse_iso(c)))
    assert got == ["2026-01-31T12:00:00", "2026-01-31T12:00:00", "2026-01-31T12:00:00", "2026-01-31T00:00:00",
                   "2026-01-31T12:00:00.250000", "2026-01-31T12:00:00.250000", "2026-01-31T06:30:00",
                   "2026-01-31T13:00:00", None, None, None, None, None, None]
    assert _map(spark, texts, text.is_iso)[:8] == [True] * 8
    assert not any(_map(spark, texts, text.is_iso)[8:13])


def test_iso_parsing_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = _map(spark, ["2024-03-10T02:30:00Z"], lambda c: text.iso_text(text.parse_iso(c)))
            assert got == ["2024-03-10T02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_numbers_as_text(spark):
    values = [12.5, 12345678.9, 0.0005, 1e7, 123.0, -98765432.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    kind = df.schema["v"].dataType
    got = [r.o for r in df.select("i", text.number_text(F.col("v"), kind).alias("o")).orderBy("i").collect()]
    assert got == ["12.5", "12345678.9", "0.0005", "10000000.0", "123.0", "-98765432.25"]


def test_sql_literals(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), None, "O'Brien")], "a double, b double, c boolean, d string")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*[text.sql_literal(F.col(c), k).alias(c) for c, k in kinds.items()]).first()
    assert tuple(row) == ("NULL", "NULL", "NULL", "'O''Brien'")


def test_relabelling_takes_the_longest_name_first(spark):
    labels = {"d_1_orders": "orders", "d_1_orders_old": "archive"}
    assert _map(spark, ["no row in d_1_orders_old or d_1_orders"], lambda c: text.relabel(c, labels)) == [
        "no row in archive or orders"]


def test_iso_forms_are_those_of_the_standard_parser(spark):
    from datetime import UTC, datetime

    good = ["2026-01-31", "20260131", "2026-W05-6", "2026W056", "2026-W05", "2020-W53-7", "2026-01-31T12", "2026-01-31 12:05", "20260131T120509",
            "2026-01-31T12:05:09,5", "2026-01-31T12:05:09.1234567", "20260131T120509.000001", "2026-01-31T12:05:09Z", "2026-01-31T23:30+01",
            "2026-01-31T00:30:00+05:45", "20260131T003000-0930", "2026-01-31T12:00:00+00:00:30", "2024-02-29T00:00:00-23:59"]
    bad = ["", "2026", "2026-02-30", "2025-02-29", "2026-1-31", "2026-W54-1", "2021-W53-1", "2026-W05-8", "2026-W05-0", "2026-01-31T", "2026-01-31T25", "2026-01-31T12:60",
           "2026-01-31T12:00+24:00", "2026-01-31T12:00+01:60", "2026-01-31T12:00 +01:00", "Easter Monday", "2026-01-31T12:00:00ZZ", None]
    got = {r.t: (r.p, r.ok) for r in spark.createDataFrame([(t,) for t in good + bad], "t string").select(
        "t", text.parse_iso(F.col("t")).alias("p"), text.is_iso(F.col("t")).alias("ok")).collect()}
    for t in good:
        want = datetime.fromisoformat(t)
        want = want.astimezone(UTC).replace(tzinfo=None) if want.tzinfo else want
        assert got[t] == (want, True), t
    for t in bad:
        assert got[t] == (None, False), t


def test_registered_labels_are_drawn(spark, ts):
    from tidemark.functions.draws import LABELS, register_label
    from tidemark.operators.generate import generate
    from tidemark.schema import declare

    register_label("hull", ["barge", "cutter", "ketch"])
    try:
        table = declare({"entity": "boats", "fields": {"id": {"type": "uuid", "primary_key": True}, "hull": {"type": "string", "key_label": "hull"}}})
        assert {r.hull for r in generate(spark, table, 200, 1, ts()).collect()} == {"barge", "cutter", "ketch"}
    finally:
        del LABELS["hull"]


def test_alias_tables_hold_the_weights():
    from fractions import Fraction

    from tidemark.functions.draws import alias_table

    for weights in ([1], [0, 1], [1, 1, 1], [6, 3, 0.5, 0], [10 ** 9, 1], [0.1] * 7 + [5], list(range(1, 150))):
        limits, others = alias_table(weights)
        n, got = len(weights), [Fraction(0)] * len(weights)
        for slot, (limit, other) in enumerate(zip(limits, others)):
            got[slot] += Fraction(limit, n << 30)
            got[other] += Fraction((1 << 30) - limit, n << 30)
        total = sum(map(Fraction, weights))
        assert sum(got) == 1 and all(abs(g - Fraction(w) / total) <= Fraction(1, 1 << 30) for g, w in zip(got, weights))
        assert all(g == 0 for g, w in zip(got, weights) if w == 0)


def test_options_of_labels(spark, ts):
    from tidemark.functions.draws import field_value
    from tidemark.schema import declare

    def boats(**spec):
        return declare({"entity": "boats", "fields": {"id": {"type": "uuid", "primary_key": True}, "x": {"type": "string", **spec}}})

    def drawn(n, **spec):
        field = boats(**spec).schema["x"]
        return [r.x for r in spark.range(n).select(field_value(field, 3, "boats", F.col("id"), F.lit(None)).alias("x")).collect()]

    weighted = drawn(20_000, key_label="job_title", ik_options={"values": {"a": 7, "b": 2, "c": 1, "d": 0}})
    for text, share in (("a", 0.7), ("b", 0.2), ("c", 0.1), ("d", 0)):
        assert abs(weighted.count(text) / 20_000 - share) < 0.02 * (share > 0) + 1e-9
    mails = drawn(50, key_label="email_address", ik_options={"domains": ["a.test"], "first": ["Zoe"]})
    assert all(m.startswith("zoe.") and m.endswith("@a.test") for m in mails)
    mails = drawn(10_000, key_label="email_address", ik_options={"domains": {"a.test": 1, "b.test": 3}})
    assert abs(sum(m.endswith("@a.test") for m in mails) / 10_000 - 0.25) < 0.02
    assert drawn(50, key_label="full_name", ik_options={}) == drawn(50, key_label="full_name")
    for bad in ({"ik_options": {"values": ["a"]}}, {"key_label": "job_title", "ik_options": {"pool": ["a"]}}, {"key_label": "job_title", "ik_options": {"values": []}},
                {"key_label": "job_title", "ik_options": {"values": {"a": -1}}}, {"key_label": "job_title", "ik_options": {"values": {"a": 0}}},
                {"key_label": "job_title", "ik_options": {"values": {"a": float("nan")}}}, {"key_label": "job_title", "ik_options": ["a"]}):
        with pytest.raises(ValueError, match="invalid_config"):
            boats(**bad)
