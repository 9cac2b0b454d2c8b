"""Personal data against the plain patterns, and identifiers learnt from contexts."""

from __future__ import annotations

import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

import hostile
from tidemark.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if valid(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=string.digits * 2 + "ab@@..  ++--()%_\u00e9\n", max_size=60))
def test_fixed_spans_equal_the_patterns(text):
    assert pii.fixed_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 100_000):
        pii.fixed_spans(text)
    assert pii.fixed_spans("0" * 6000 + ".0.0.1") == [(0, 1, 6006)]


def test_contexts_discover_unseen_identifiers(spark):
    known = [(i, f"please write to our desk: user{i}@mail.example.org for help with case number two") for i in range(12)]
    masked = [(100, "please write to our desk: agent_x(at)post-4711.example for help"), (101, "the agent_x(at)post-4711.example box is full"),
              (102, "order no. 12-3456-x was shipped on day 2024-06-01"), (103, "nothing here")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(known + masked, "doc_id bigint, text string")).collect()}
    for i in (100, 101):
        text = dict(masked)[i]
        at = text.index("agent_x")
        assert got[i].spans == f"email:{at}:{at + len('agent_x(at)post-4711.example')}" and got[i].n_email == 0 and got[i].n_found == 1
    assert got[102].spans == got[103].spans == ""
    assert all(got[i].n_email == 1 and got[i].n_found == 0 for i in range(12))
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(known + masked, "doc_id bigint, text string")).collect()}
    assert clean[0] == "please write to our desk: [EMAIL] for help with case number two"
    assert clean[101] == "the [EMAIL] box is full" and clean[102] == dict(masked)[102]


def test_rounds_go_on_until_nothing_new_is_found(spark):
    rows, levels = [], 6
    name = lambda level, i: f"agent{'abc'[i]}_{level}(at)post-47{level}{i}.example"
    for level in range(levels):  # each level's instances are found with those of the level before
        ids = [f"user{level}n{i}@mail.example.org" for i in range(12)] + [name(k, i) for k in (level - 1, level) if k >= 0 for i in range(3)]
        rows += [f"{w}one{'abcdef'[level]} {w}two{'abcdef'[level]} {x} {w}x{'abcdef'[level]}{'abcdefghijklmnopqr'[n]}y" for n, x in enumerate(ids) for w in "pq"]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    found = {rows[r.doc_id].split()[2] for r in got if r.n_found}
    assert found == {name(level, i) for level in range(levels) for i in range(3)}


def test_context_words_are_read_whole():
    long = "w" * 60
    left, right = f"{long}a {long}b id-4711 next", f"see the id-4711 {long}a"
    at = left.index("id-")
    assert len(pii.patterns(left, at, at + 7)) == 3
    assert pii.patterns(left, at, at + 7)[1] != pii.patterns(left.replace("b id", "c id"), at, at + 7)[1]
    assert pii.patterns(right, 8, 15)[2] != pii.patterns(right[:-1] + "b", 8, 15)[2]
    assert pii.patterns("a b " + "x-" * 40 + "123", 4, 87)[0] != pii.patterns("a b " + "x-" * 39 + "x123", 4, 86)[0]


def test_hostile_rows(spark, hostile_docs, no_docs):
    got = pii.personal_data(hostile_docs).collect()
    assert len(got) == len(hostile.rows())
    assert {(r.n_email, r.n_phone) for r in got if r.doc_id == 10} == {(1, 1)}
    assert all(r.spans == "" and r.base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" for r in got if r.doc_id in (0, 1, 2, None))
    out = pii.redacted(hostile_docs)
    assert out.columns == hostile_docs.columns and out.count() == len(hostile.rows())
    assert out.where("doc_id = 10").first().text == "mail me at [EMAIL] or [PHONE] now"
    assert pii.personal_data(no_docs).count() == pii.redacted(no_docs).count() == 0
