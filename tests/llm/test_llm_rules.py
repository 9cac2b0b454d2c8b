"""Divergence rules and URL aliases against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter
from urllib.parse import urljoin

import duckdb
import hostile
from pyspark.sql import functions as F

from tidemark.llm import aliases, divergence
from tidemark.llm.queries import LLM_SQL

SPACE = r"[\x20\x09-\x0D]+"


def base(text):
    w = [x for x in re.split(SPACE, text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    texts = ["", None, "a", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x", "x " * 40, "l1 x\nl1 x\n \nl1 x\nl2", "# a* <b>|\u00e9$",
             "\u00e9t\u00e9 \u4e2d\u6587 " * 9, "a b c d e f g h i j k " * 2 + "z " + "c d e f g", *[r[1] for r in hostile.rows()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for r in divergence.judged(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (r.base_failed and r.kept)


def js(p, q):
    term = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0, sum(term(x, (x + y) / 2) + term(y, (x + y) / 2) for x, y in zip(p, q)) / 2))


def classes(words):
    t = "".join(words)
    upper, digits, marks = (len(re.findall(p, t)) for p in ("[A-Z]", "[0-9]", r"[!-/:-@\[-`{-~]"))
    symbols = sum(c in "#*$%&|<>" for c in t)
    return [upper, digits, symbols, marks - symbols, len(t.encode()) - len(t), len(t) - upper - digits - marks]


def test_distances_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", 120)
    rows = [(i, "en", " ".join(f"{'the of and'.split()[k % 3]} w{(i * k) % 57}x" for k in range(60))) for i in range(20)]
    rows += [(50, "en", "LOUD! " * 30 + "of SHOUT? " * 30), (51, "xx", "the of and " * 40), (52, None, "the w1x " * 80), (53, "en", "short text of few words " * 2)]
    lang = {i: x for i, x, _ in rows}
    per = {}
    for i, x, t in rows:
        for ref in {x or "", ""}:
            per.setdefault(ref, []).extend(t.split())
    got = {r.doc_id: r for r in divergence.judged(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()}
    for i, _, t in rows:
        ref = lang[i] or ""
        if len(per[ref]) < 120:
            assert got[i].word_distance is None and got[i].char_distance is None
            continue
        c = Counter(per[ref])
        common = sorted(w for w, n in c.items() if n >= 0.01 * len(per[ref]))
        mine, words = Counter(t.split()), t.split()
        if len(words) < 50:
            assert got[i].word_distance is None
            continue
        hist = lambda k, n: [k[w] / n for w in common] + [1 - sum(k[w] for w in common) / n]
        assert abs(got[i].word_distance - js(hist(mine, len(words)), hist(c, len(per[ref])))) < 1e-9
        unit = lambda v: [x / sum(v) for x in v]
        if sum(classes(words)) >= 250:
            assert abs(got[i].char_distance - js(unit(classes(words)), unit(classes(per[ref])))) < 1e-9


def test_other_languages_change_no_verdict(spark):
    few = [(i, "ru", " ".join(f"слово{i}х{k} и в" for k in range(60))) for i in range(3)]
    english = lambda n: [(100 + i, "en", " ".join(f"{'the of and'.split()[k % 3]} w{(i * k) % 57}x" for k in range(120))) for i in range(n)]
    for n in (1, 60, 700):
        got = divergence.judged(spark.createDataFrame(few + english(n), "doc_id bigint, lang string, text string")).collect()
        assert all(r.kept and r.word_distance is None and r.char_distance is None for r in got if r.doc_id < 100)
        assert all((r.word_distance is None) == (n * 240 < divergence.LEAST) for r in got if r.doc_id >= 100)


def test_divergence_sql_on_hostile_rows(hostile_docs):
    named = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    docs = hostile_docs.where("text is null or length(text) < 10000")  # the SQL is quadratic in a text
    got = divergence.judged(docs).select(named).toPandas()
    with duckdb.connect() as db:
        db.register("documents", docs.select("doc_id", "text", "lang").toArrow())
        want = db.execute(LLM_SQL["op5_divergence"]).df()[named]
    # rows without a doc_id share their repeated words in the SQL; they are compared in the tests of the counts
    order = lambda t: sorted(map(str, t[t.doc_id.notna() & ~t.doc_id.isin([1, 5])].astype({"doc_id": int}).values.tolist()))
    assert order(got) == order(want)


def test_divergence_of_hostile_rows(hostile_docs, no_docs):
    got = divergence.judged(hostile_docs).collect()
    assert len(got) == len(hostile.rows()) and all(r.base_failed and not r.kept for r in got if r.doc_id in (0, 1, 2, 3, 4))
    assert divergence.judged(no_docs).count() == 0


CANON = '<html><head><link rel="canonical" href="{}"></head></html>'


def test_blocks_reach_aliases_and_allows_win(spark):
    pages = [
        (1, "http://a.org/1", CANON.format("https://x.example.com/en/9")),       # alias of a blocked URL, not crawled
        (2, "https://A.org/1?utm_source=z#top", None),                            # the same URL spelt otherwise
        (3, "http://b.org/2", '<META http-equiv="refresh" content="0; URL=http://a.org/1">'),
        (4, "http://c.org/3", CANON.format("/4")), (5, "http://c.org/4", CANON.format("http://d.net/fr/1")),
        (6, "http://e.org/5", CANON.format("http://f.org/6")), (7, "http://f.org/6", ""),
        (8, "http://g.org/7", CANON.format("http://h.net/es/1") + "<meta http-equiv=refresh content='1;url=http://shop.com/'>"),
        (9, "http://shop.com/", None), (10, "http://h.net/es/1", None), (11, None, None), (12, "mailto:x", "<a>"), (13, "http://", ""),
        (14, "http://www.example.com/en/1", None), (15, "http://my.example.com/en/1", None), (16, "http://example.com/de/1", CANON.format("http://q.org/1")),
        (17, "http://com/", None), (18, "http://notcom", None), (19, "http://j.org/1", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rule", F.lit("x")).withColumn("key", F.lit(1))
    moved = spark.createDataFrame([("http://j.org/1", "http://k.net/fr/2"), (None, "http://k.net/fr/2")], "source string, target string")
    got = {r.page_id: (r.rule, r.verdict) for r in aliases.judged(df, redirects=moved).collect()}
    block, allow = (None, "block"), (None, "allow")
    assert got == {
        1: block, 2: block, 3: block, 4: block, 5: block, 6: allow, 7: allow, 8: allow, 9: ("com/", "allow"), 10: ("net/es/", "block"), 11: allow,
        12: allow, 13: allow, 14: ("www.example.com/en/", "allow"), 15: ("example.com/en/", "block"), 16: ("com/", "allow"), 17: ("com/", "allow"),
        18: allow, 19: block}
    assert aliases.judged(df.limit(0)).count() == 0
    assert aliases.judged(df.union(df)).count() == 2 * len(pages)


FORMS = ["page2.html", "./a/../b.html", "../up", "../../../top", "/root", "/a/./b/..", "?q=1", "#here", "//other.org/x", "https://other.org/y?a=1&b=2", "sub/", "..", ".",
         "/go?to=http://net/es/1", "mailto:x@y.z", "x.y/..z/...", "", "//", "a//b", "?", "/p\u00e9"]


def test_targets_resolve_as_in_browsers(spark):
    pages = ["http://Site.org/a/b/page.html?x=1#f", "http://site.org", "http://site.org/", "http://site.org/a/", "http://site.org?q=/z/y"]
    rows = [(u, t) for u in pages for t in FORMS]
    df = spark.createDataFrame(rows, "url string, t string")
    key = lambda c: aliases.key_of(F.col(c))
    got = df.withColumn("full", aliases.resolved(F.col("url"), F.col("t"))).select("url", "t", "full", key("full").alias("k"))
    want = spark.createDataFrame([(u, t, urljoin(u, t) if t else None) for u, t in rows], "url string, t string, w string").select("url", "t", "w", key("w").alias("kw"))
    trim = lambda k: (k or "").split("?")[0].rstrip("/") + "?" + ((k or "").split("?") + [""])[1]  # noqa: E731  a host alone and its root folder differ in text only
    for r in got.join(want, ["url", "t"]).collect():
        if r.t not in ("", "//", "a//b", "?"):  # of these urljoin keeps or drops parts that browsers do not
            assert trim(r.k) == trim(r.kw), r


def test_every_form_of_a_link_counts(spark):
    bad = "http://net/es/1"
    forms = [
        f'<link rel="nofollow canonical" href="{bad}">', f"<link href={bad} rel=canonical>", f"<LINK REL='Canonical' HREF='{bad}'/>", f'<link\nhref="{bad}"\n rel=canonical/>',
        f'<link rel=canonical href="http://ok.org/1"><link rel=canonical href="{bad}">', f'<link rel=icon href="http://ok.org/1"><link rel=canonical href=" {bad} ">',
        f'<meta http-equiv="refresh" content="30"><meta http-equiv=refresh content="0; url={bad}">', f"<meta content=\"0;URL='{bad}'\" http-equiv='REFRESH'>",
        f'<meta http-equiv=refresh content="5; {bad}">', '<base href="http://net/es/"><link rel=canonical href="1">', '<base href="//net/fr/x"><link rel=canonical href="../es/1">',
        '<link rel=canonical href="//net/es/1?a=1&amp;b=2">', '<link rel=canonical href="http://net/es/1?a=1&#38;b=2">']
    fine = [f'<link rel="canonicals" href="{bad}">', f'<link data-rel="canonical" href="{bad}">', f'<link rel=canonical data-href="{bad}">', f'<linked rel=canonical href="{bad}">',
            f'<meta http-equiv="refreshed" content="0;url={bad}">', f'<link rel=canonical href="/go?to={bad}">', '<link rel=canonical>', "<link rel=canonical href=''>", "<link", "<>", None, "",
            "<link rel=canonical href=" + "x" * 300_000 + ">", "<link " * 20_000]
    rows = [(i, f"http://p{i}.org/d/e", h) for i, h in enumerate(forms)] + [(100 + i, f"http://q{i}.org/d/e", h) for i, h in enumerate(fine)]
    # a relative target of one page leads to another, which is blocked by its own target
    rows += [(200, "http://r.org/d/1", '<link rel=canonical href="2.html?a=1&amp;b=2">'), (201, "http://r.org/d/2.html?a=1&b=2", f'<link rel=canonical href="{bad}">'),
             (202, None, f'<link rel=canonical href="{bad}">'), (203, "no url", forms[0]), (None, None, None), (None, "http://r.org/d/1", None), (200, "http://r.org/d/1", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = aliases.judged(df).collect()
    for r in got:
        blocked = r.host == "r.org" or r.page_id is not None and r.page_id < 100
        assert r.verdict == ("block" if blocked else "allow"), (r, rows[r.page_id % 100] if r.page_id is not None else None)
    with duckdb.connect() as db:
        db.register("pages", df.toArrow())
        want = db.execute(LLM_SQL["op8_url_aliases"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_hosts_and_paths(spark):
    urls = ["HTTP://A.b.Com:80/X/y?q=/z#f", "x://h?q", "x://h#f", "x://\u00c4B/p\nq", "no scheme", "://", "a://b://c/d", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(aliases.host_of(F.col("url")).alias("h"), aliases.path_of(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [("a.b.com:80", "/X/y"), ("h", ""), ("h", ""), ("\u00c4b", "/p\nq"), ("", ""), ("", ""), ("b:", "//c/d"), ("", "")]
