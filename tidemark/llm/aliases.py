"""URL filters with redirect equivalence.

A page is judged by the longest rule that fits its URL. Pages without a rule take the verdict of their aliases:
URLs are joined by redirects (a table, if given), all ``meta refresh`` targets and all ``link rel=canonical`` targets
of a page, and a connected component with a blocked URL blocks its members, unless one of its URLs is explicitly allowed. A page's
own rule always decides for the page itself. Without any of these a page is allowed.

DataFrame functions only. Components never leave the executors; only components that are blocked are joined back.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.divergence import let

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

BLANK = r"\x20\x09-\x0D"
TAG = rf"(?i)<(?:link|meta)[{BLANK}/][^<>]*>"
BASE = rf"(?i)<base[{BLANK}/][^<>]*>"
CANONICAL = rf"(?i)(?:^|[{BLANK}])canonical(?:[{BLANK}/]|\z)"
REFRESH = rf"(?i)^[{BLANK}]*refresh[{BLANK}/]*\z"
DELAYED = rf"(?i)^[{BLANK}]*[0-9.]*[{BLANK}]*[;,]?[{BLANK}]*(?:url[{BLANK}]*=[{BLANK}]*)?[\"']?([^\"']*)"  # content of a refresh
EDGE = "\"' \t\n\v\f\r"  # what may enclose a value
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def attribute(name: str) -> str:
    """The pattern of an attribute of a tag; its value, quoted or not, is the group."""
    return rf"(?i)[{BLANK}\"'/]{name}[{BLANK}]*=[{BLANK}]*(\"[^\"]*\"|'[^']*'|[^{BLANK}\"'>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What two spellings of one URL share: host, path and query without scheme, fragment and campaign parameters.
    Null for what is no URL."""
    def spelt(x: Column) -> Column:
        query = F.regexp_replace(F.regexp_replace(x["query"], r"(^|&)utm_[^&]*", ""), "^&", "")
        return let(query, lambda q: F.when(x["host"] != "", F.concat(x["host"], x["path"], F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))))

    return let(let(url, lambda u: F.struct(host_of(u).alias("host"), path_of(u).alias("path"), F.regexp_extract(_rest(u), r"^[^?#]*\?([^#]*)", 1).alias("query"))), spelt)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (size, verdict, name); null if none does. Of equal ones, allow."""
    all_ = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(v).alias("verdict"), F.lit(h + p).alias("name"),
                              F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(all_, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.array_max(fits)


def _value(tag: Column, name: str) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_extract(tag, attribute(name), 1), F.lit(EDGE)), AMPERSAND, "&")


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    segments = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.\.?)\z", "$1$2/"), "/")
    return F.aggregate(segments, F.lit(""), lambda sofar, x: F.when(x == "..", F.regexp_replace(sofar, r"/[^/]*\z", "")).when(x == ".", sofar).otherwise(
        F.concat(sofar, F.lit("/"), x)))


def resolved(url: Column, to: Column) -> Column:
    """The URL that ``to`` names on the page ``url``: absolute, or relative to its host or folder. Null if that has no host."""
    def joined(x: Column) -> Column:
        folder = F.regexp_extract(x["path"], r"^([\s\S]*/)", 1)
        path = F.when(x["place"] == "", x["path"]).when(x["place"].startswith("/"), x["place"]).otherwise(
            F.concat(F.when(folder == "", "/").otherwise(folder), x["place"]))
        plain = let(path, lambda p: F.when(F.instr(p, "/.") > 0, _without_dots(p)).otherwise(p))
        return F.concat(F.lit("http://"), x["host"], plain, F.substring(x["to"], F.length(x["place"]) + 1, F.length(x["to"])))

    parts = let(F.struct(url.alias("url"), to.alias("to")), lambda x: F.struct(
        x["url"].alias("url"), x["to"].alias("to"), host_of(x["url"]).alias("host"), path_of(x["url"]).alias("path"), F.regexp_extract(x["to"], "^[^?#]*", 0).alias("place")))
    return let(parts, lambda x: F.when(x["to"].rlike(SCHEME), x["to"]).when(x["to"].startswith("//"), F.concat(F.lit("http:"), x["to"])).when(
        x["to"].startswith("#"), x["url"]).when(x["host"] != "", joined(x)))


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b): keys of a page and of every URL that its html names as canonical or next.

    Relative targets are resolved on the page's URL, or on its first ``base``; ampersands may be written as entities.
    A tag ends at the first ``>``; one with ``<`` inside is none, so that reading takes time linear in the html.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tags = pages.select(F.col("url").cast("string").alias("url"), F.regexp_extract(html, BASE, 0).alias("base"), F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("tag"))
    is_link, content = F.substring("tag", 2, 1).isin("l", "L"), _value(F.col("tag"), "content")
    delayed = F.btrim(F.regexp_extract(content, DELAYED, 1), F.lit(EDGE))
    target = F.when(is_link & _value(F.col("tag"), "rel").rlike(CANONICAL), _value(F.col("tag"), "href")).when(
        ~is_link & _value(F.col("tag"), "http-equiv").rlike(REFRESH), delayed)
    targets = tags.select("url", _value(F.col("base"), "href").alias("base"), target.alias("to")).where("to != ''")
    full = targets.select("url", F.when(F.col("base") == "", F.col("url")).otherwise(resolved(F.col("url"), F.col("base"))).alias("base"), "to")
    ends = full.select(key_of(F.col("url")).alias("a"), key_of(resolved(F.col("base"), F.col("to"))).alias("b"))
    return ends.where("a is not null and b is not null and a != b").distinct()


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of (page_id, url, html).

    ``redirects`` has string columns (source, target). Null URLs and ones without ``://`` have empty host and path,
    no rule and no alias: they are allowed. Null html names no alias. Repeated rows get equal verdicts; other
    columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))  # no key begins with a slash
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    edges = edges_of(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(F.col("source")), key_of(F.col("target"))))
    roots = components(edges)
    # URLs that aliases name count with their own rules, crawled or not
    named = roots.select("root", F.concat(F.lit("http://"), F.col("node")).alias("url"))
    decided = named.select("root", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict")).groupBy("root").agg(
        F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    blocked = roots.join(decided.where("block and not coalesce(allow, false)").select("root"), "root").select(F.col("node").alias("key"), F.lit("block").alias("alias"))
    return rows.join(blocked, "key", "left").select(
        "page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("alias"), F.lit("allow")).alias("verdict"))
