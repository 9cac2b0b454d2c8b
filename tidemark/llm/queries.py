"""Registered corpus queries: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import aliases, bitpack, decontaminate, divergence, jaccard, language, mixing_lm, near_dup, packing, pii, pivots, quality, runs
from tidemark.llm.tokenizers_path import definition
from tidemark.session import scratch_path

LLM_QUERIES, LLM_SQL = {}, {}


def _query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def _divergence_sql() -> str:
    """The same rules over DuckDB lists."""
    d, space = divergence, r"[\x20\x09-\x0D]+"
    counts = lambda t: (f"length({t}) - length(regexp_replace({t}, '[A-Z]', '', 'g'))", f"length({t}) - length(regexp_replace({t}, '[0-9]', '', 'g'))",
                        f"length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '', 'g'))", f"length({t}) - length(regexp_replace({t}, '[!-/:-@\\[-`{{-~]', '', 'g'))",
                        f"strlen({t}) - length({t})")
    u, n, s, m, f = (f"({x})" for x in counts("joined"))
    classes = f"[{u}, {n}, {s}, {m} - {s}, {f}, length(joined) - {u} - {n} - {m}]"
    js = lambda p, q: (f"sqrt(greatest(0.0::DOUBLE, list_sum(list_transform(range(1, len({p}) + 1), lambda i: "  # noqa: E731
                       f"CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END + "
                       f"CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END)) / 2))")
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda w: w <> '') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
runs AS (SELECT doc_id, i, words[i + 1 : i + {d.WINDOW}] AS run FROM (SELECT doc_id, words, unnest(range(len(words) - {d.WINDOW - 1})) AS i FROM t WHERE len(words) >= {d.WINDOW})),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range({d.WINDOW}) g(j) WHERE n > 1 GROUP BY 1),
b AS (SELECT doc_id, lang, words, array_to_string(words, '') AS joined, len(words) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup, coalesce(c.n, 0) AS n_repeat
      FROM t LEFT JOIN cover c USING (doc_id)),
c AS (SELECT *, {classes} AS chars, {s} AS n_symbols FROM b),
w AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM t) GROUP BY ALL),
totals AS (SELECT lang AS ref, sum(n) AS total FROM w GROUP BY 1),
kept AS (SELECT ref, total FROM totals WHERE ref <> '' AND total >= {d.LEAST}
         UNION ALL SELECT '', sum(total) FROM totals),
shares AS (SELECT ref, word, sum(n)::DOUBLE / any_value(total) AS share FROM kept JOIN w ON ref = lang OR ref = '' GROUP BY ref, word),
common AS (SELECT ref, list(word ORDER BY word) AS words, list(share ORDER BY word) AS shares FROM shares WHERE share >= {d.COMMON} GROUP BY 1),
sums AS (SELECT ref, list_transform(range(1, {d.CLASSES + 1}), lambda i: list_sum(list_transform(l, lambda x: x[i])))::DOUBLE[] AS c
         FROM (SELECT ref, list(chars) AS l FROM kept JOIN c ON ref = lang OR ref = '' GROUP BY 1)),
refs AS (SELECT k.ref, coalesce(words, []) AS common, list_append(coalesce(shares, []), greatest(1 - coalesce(list_sum(shares), 0), 0.0)) AS of_words,
                list_transform(c, lambda x: x / list_sum(c)) AS of_chars FROM kept k LEFT JOIN common USING (ref) JOIN sums USING (ref)),
j AS (SELECT c.*, r.common, r.of_words, r.of_chars, list_transform(r.common, lambda x: len(list_filter(c.words, lambda y: y = x))::DOUBLE) AS tally
      FROM c LEFT JOIN refs r ON r.ref = lang),
h AS (SELECT *, list_transform(list_append(tally, n_words - coalesce(list_sum(tally), 0)), lambda x: x / n_words) AS pw, list_transform(chars, lambda x: x::DOUBLE / list_sum(chars)) AS pc FROM j),
dist AS (SELECT *, CASE WHEN n_words >= {d.WORDS_GUARD} AND len(common) > 0 THEN {js('pw', 'of_words')} END AS dw,
                CASE WHEN list_sum(chars) >= {d.CHARS_GUARD} AND of_chars IS NOT NULL THEN {js('pc', 'of_chars')} END AS dc,
                n_words < {d.LEAST_WORDS} OR 100 * n_repeat > {d.REPEATED} * n_words AS failed FROM h)
SELECT doc_id, n_words::BIGINT AS n_words, length(joined)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
       failed AS base_failed, NOT failed AND coalesce(dw, 0) <= {d.WORD_LIMIT} AND coalesce(dc, 0) <= {d.CHAR_LIMIT} AS kept FROM dist"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


@_query
def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    bitpack.write(_table(spark, sf_dir, "documents"), path, definition("byte_bpe_50k.json"))
    return bitpack.digests(spark, path)


@_query
def op7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), definition("word_bpe_49k.json"))


@_query
def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.scored(_table(spark, sf_dir, "documents"))


@_query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


@_query
def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(_table(spark, sf_dir, "documents")).drop("word_distance", "char_distance")


LLM_SQL["op5_divergence"] = _divergence_sql()


def _url_sql(url: str) -> dict[str, str]:
    rest = f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{upper}', '{lower}'), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    kept = f"regexp_replace(regexp_replace(coalesce(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '')"
    return {"host": host, "path": path, "key": f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"}


def _aliases_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in aliases.RULES)
    page, to, named, base = _url_sql("url"), _url_sql("full_to"), _url_sql("'http://' || node"), _url_sql("base")
    text = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    value = lambda tag, name: (f"regexp_replace(trim(regexp_extract({tag}, {text(aliases.attribute(name))}, 1), {text(aliases.EDGE)}), "  # noqa: E731
                               f"{text(aliases.AMPERSAND)}, '&', 'g')")

    def resolved(url: str, host: str, path: str, to: str) -> str:
        place, folder = f"regexp_extract({to}, '^[^?#]*')", f"regexp_extract({path}, '^([\\s\\S]*/)', 1)"
        full = f"(CASE WHEN {place} = '' THEN {path} WHEN starts_with({place}, '/') THEN {place} ELSE CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {place} END)"
        parts = f"string_split(regexp_replace(substr({full}, 2), '(^|/)(\\.\\.?)\\z', '\\1\\2/'), '/')"
        plain = (f"CASE WHEN strpos({full}, '/.') > 0 THEN list_reduce([''] || {parts}, lambda s, x: CASE x WHEN '..' THEN regexp_replace(s, '/[^/]*\\z', '') "
                 f"WHEN '.' THEN s ELSE s || '/' || x END) ELSE {full} END")
        return (f"CASE WHEN regexp_matches({to}, {text(aliases.SCHEME)}) THEN {to} WHEN starts_with({to}, '//') THEN 'http:' || {to} WHEN starts_with({to}, '#') THEN {url} "
                f"WHEN {host} <> '' THEN 'http://' || {host} || {plain} || substr({to}, length({place}) + 1) END")

    best = "arg_max(struct_pack(v := v, name := h || p), length(h || p) * 2 + CASE WHEN v = 'allow' THEN 1 ELSE 0 END)"
    fits = "(x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)"
    return f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {rules}),
x AS (SELECT page_id, url, coalesce(html, '') AS html, {page['host']} AS host, {page['path']} AS path, {page['key']} AS key FROM pages),
hosts AS (SELECT DISTINCT host, path FROM x),
ruled AS (SELECT x.host, x.path, {best} AS r FROM hosts x JOIN rules ON {fits} GROUP BY 1, 2),
tags AS (SELECT url, host, path, key, regexp_extract(html, {text(aliases.BASE)}) AS base_tag, unnest(regexp_extract_all(html, {text(aliases.TAG)})) AS tag FROM x),
named AS (SELECT url, host, path, key, {value('base_tag', 'href')} AS base_to,
                 CASE WHEN lower(tag[2]) = 'l' AND regexp_matches({value('tag', 'rel')}, {text(aliases.CANONICAL)}) THEN {value('tag', 'href')}
                      WHEN lower(tag[2]) = 'm' AND regexp_matches({value('tag', 'http-equiv')}, {text(aliases.REFRESH)})
                      THEN trim(regexp_extract({value('tag', 'content')}, {text(aliases.DELAYED)}, 1), {text(aliases.EDGE)}) END AS t FROM tags),
based AS (SELECT key, t, CASE WHEN base_to = '' THEN url ELSE {resolved('url', 'host', 'path', 'base_to')} END AS base FROM named WHERE t <> ''),
placed AS (SELECT key, t, base, {base['host']} AS host, {base['path']} AS path FROM based),
links AS (SELECT key AS a, {resolved('base', 'host', 'path', 't')} AS full_to FROM placed),
edges AS (SELECT a, {to['key']} AS b FROM links WHERE full_to IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(a, node) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a),
seen AS (SELECT a, {named['host']} AS host, {named['path']} AS path FROM reach),
judged AS (SELECT x.a, {best} AS r FROM seen x JOIN rules ON {fits} GROUP BY x.a, x.host, x.path),
blocked AS (SELECT a FROM judged GROUP BY a HAVING bool_or(r.v = 'block') AND NOT bool_or(r.v = 'allow'))
SELECT page_id, x.host, x.path, r.name AS rule,
       coalesce(r.v, CASE WHEN key IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN ruled ON ruled.host = x.host AND ruled.path = x.path"""


LLM_SQL["op8_url_aliases"] = _aliases_sql()


@_query
def op8_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.judged(_table(spark, sf_dir, "pages"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), change=True)


@_query
def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.clustered(_table(spark, sf_dir, "embeddings"))


def _clusters_sql() -> str:
    """Every round is two steps: each vector's nearest centroid, and the floor of each centroid's mean."""
    k, axes = pivots.CENTROIDS, f"range(1, {pivots.DIMENSIONS + 1})"
    apart = f"list_sum(list_transform({axes}, lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({pivots.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {pivots.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS k, v AS c FROM kept QUALIFY k < {k})"]
    for n in range(1, pivots.ROUNDS + 2):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, min({k} * {apart} + k) AS m FROM kept, c{n - 1} GROUP BY ALL)")
        steps.append(f"s{n} AS (SELECT m % {k} AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, {axes} t(i) GROUP BY ALL)")
        steps.append(f"m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM s{n} GROUP BY k)")
        steps.append(f"c{n} AS MATERIALIZED (SELECT k, coalesce(mean, c) AS c FROM c{n - 1} LEFT JOIN m{n} USING (k))")
    last = pivots.ROUNDS + 1
    return f"""WITH {", ".join(steps)},
d AS (SELECT vec_id, (m % {k})::INT AS cluster, m // {k} AS distance FROM a{last})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d JOIN c{last - 1} ON k = cluster"""


LLM_SQL["op12_ptolemaic_clusters"] = _clusters_sql()


@_query
def op13_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"))


LLM_SQL["op13_jaccard_components"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                      '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {jaccard.SHINGLE} THEN list_transform(range(1, len(words) - {jaccard.SHINGLE - 2}), lambda i: array_to_string(words[i : i + {jaccard.SHINGLE - 1}], ' '))
                                          WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {jaccard.PER_CENT} * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, min(b)), w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
