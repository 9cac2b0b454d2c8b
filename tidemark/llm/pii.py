"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

What the fixed patterns find (e-mail, IP, card and phone numbers) are seed entities. Around every seed, and around
every other token that looks like an identifier (digits or an at sign), lexical patterns are read: the two words
before it, the word before and the word behind, the word before and the token's shape. Patterns and instances form
a bipartite graph over the whole corpus, which Spark scores in rounds:

* a pattern's confidence in a kind is the mean score, over its distinct instances, of being of that kind; it is
  accepted with SUPPORT scored instances and a confidence of CONFIDENCE;
* an instance that is no seed scores 1 - product(1 - confidence) over its accepted patterns, and is discovered
  once that exceeds CONFIDENCE; it then counts for the patterns of the next round.

A discovered instance keeps its kind, so confidences and scores only rise; rounds go on until none does.

Discovered instances are spans wherever they occur. Seeds' spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textblocks import blocks, lean
from tidemark.session import pin, unpin

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE = 3, 0.9
SETTLED = 1e-9  # a score that rises by no more stays as it is
CONTEXT = 48  # characters; longer words and shapes are known by their digests

# fixed patterns
_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,;:!?.|#*$%&="
_DIGITS = re.compile(r"[0-9]")
_ZEROS = dict.fromkeys(map(ord, "0123456789"), "0")
_SHAPE = re.compile(r"[^\W\d_]+|[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in code points, in that order; each kind leftmost, non-overlapping."""
    out, at = [], 0
    while (at := text.find("@", at)) >= 0:
        floor = out[-1][2] if out else 0
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        at = m.end() if m else at + 1
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _short(word: str) -> str:
    return word if len(word) <= CONTEXT else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def _word(token: str) -> str:
    return _short(token.lower().translate(_ZEROS))


def _before(text: str, start: int) -> list[str]:
    """The last two words before ``start``, whole."""
    size = CONTEXT
    while True:
        left = text[max(0, start - size) : start]
        found = left.split()
        if size >= start or len(found) > 2 or (len(found) == 2 and left[0].isspace()):
            return found[-2:]
        size *= 2


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of the token at [start, end)."""
    before, behind = [_word(t) for t in _before(text, start)], [_word(m[0]) for m in [_TOKEN.search(text, end)] if m]
    if not before:
        return []
    shape = _short(_SHAPE.sub(lambda m: "0" if m[0][0].isdecimal() else "a", text[start:end]))
    out = [f"{before[-1]} _ ~{shape}"]
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if behind:
        out.append(f"{before[-1]} _ {behind[0]}")
    return out


def identifier_tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with an at sign, or three digits and five characters, that touch no span; without edge punctuation."""
    taken = sorted((s, e) for s, _, e in spans)
    i = 0
    for m in _TOKEN.finditer(text):
        if "@" not in m[0] and not _DIGITS.search(m[0]):
            continue
        start = m.end() - len(m[0].lstrip(_EDGE))
        end = m.start() + len(m[0].rstrip(_EDGE))
        if end - start < 5 or (text.find("@", start, end) < 0 and len(_DIGITS.findall(text, start, end)) < 3):
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(s < end and e > start for s, e in taken[i : i + 8]):
            yield start, end


SCAN = ("doc_id bigint, h bigint, base array<struct<start:int,kind:int,end:int>>, "
        "seen array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>")


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    seen_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text")):
            marks = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))])
            base, seen = [[]] * (hi - lo), [[]] * (hi - lo)
            for i in np.flatnonzero(np.diff(marks[ends])).tolist():  # the others have neither digit nor at sign
                text = data[ends[i] : ends[i + 1]].tobytes().decode()
                spans = fixed_spans(text)
                base[i] = [{"start": s, "kind": k, "end": e} for s, k, e in spans]
                tokens = [(k, s, e) for s, k, e in spans] + [(None, s, e) for s, e in identifier_tokens(text, spans)]
                seen[i] = [{"kind": k, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": patterns(text, s, e)} for k, s, e in tokens]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), batch.column("h").slice(lo, hi - lo), pa.array(base, base_type), pa.array(seen, seen_type)],
                ["doc_id", "h", "base", "seen"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, the seeds' spans, and every identifier-like token with its patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(_scan, SCAN)


def discovered(scanned: DataFrame) -> DataFrame:
    """Instances beyond the seeds with the kind that their contexts give them: (instance, kind, score)."""
    tokens = scanned.select(F.explode("seen").alias("t")).select("t.instance", "t.kind", F.explode("t.patterns").alias("pattern"))
    edges = pin(tokens.groupBy("pattern", "instance").agg(F.min("kind").alias("seed")), "edges")
    # an instance is a seed if it is one anywhere
    seeds = pin(edges.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    scores, found = seeds, None
    while True:
        rated = edges.select("pattern", "instance").join(scores, "instance", "left")
        sums = rated.groupBy("pattern").agg(F.count("*").alias("n"), *[f(F.when(F.col("kind") == k, F.col("score"))).alias(f"{w}{k}")
                                                                        for k in range(len(KINDS)) for f, w in ((F.sum, "s"), (F.count, "c"))])
        per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("s"), F.col(f"c{k}").alias("c")) for k in range(len(KINDS))]))
        good = (sums.select("pattern", "n", per_kind.alias("x")).where((F.col("x.c") >= SUPPORT) & (F.col("x.s") / F.col("n") >= CONFIDENCE - 0.15))
                .select("pattern", "x.kind", (F.col("x.s") / F.col("n")).alias("confidence")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(0.02))))
        ranked = (edges.select("pattern", "instance").join(seeds.select("instance"), "instance", "left_anti").join(good, "pattern")
                  .groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score")))
        if found is not None:  # what is found stays so
            kinds = found.select("instance", F.col("kind").alias("known"))
            ranked = ranked.join(kinds, "instance", "left").where("known is null or kind = known").drop("known").unionByName(found)
        best = ranked.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("m")).select(
            "instance", (-F.col("m.col2")).cast("int").alias("kind"), F.col("m.score").alias("score")).where(F.col("score") >= CONFIDENCE)
        best = pin(best, "found")
        before = best.limit(0) if found is None else found
        rose = best.join(before.select("instance", F.col("score").alias("before")), "instance", "left").where(F.col("before").isNull() | (F.col("score") - F.col("before") > SETTLED))
        done = rose.isEmpty()
        unpin(found)
        found, scores = best, seeds.unionByName(best)
        if done:
            break
    return found


def found_spans(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """Spans of discovered instances by (doc_id, h): one array for each."""
    tokens = scanned.select("doc_id", "h", F.explode("seen").alias("t")).where("t.kind is null").select("doc_id", "h", "t.start", "t.end", "t.instance")
    spans = tokens.join(found.select("instance", "kind"), "instance")
    return spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))


def _text(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _joined(left: DataFrame, hashed: str, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "_tm_doc", "h": "_tm_hash", "more": "_tm_more"})
    return left.join(spans, left["doc_id"].eqNullSafe(F.col("_tm_doc")) & (left[hashed] == F.col("_tm_hash")), "left")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of each row.

    Null and empty texts have no spans (empty ``spans``, the digest of an empty string). Equal texts under one id
    get equal spans; other columns are not read.
    """
    scanned = pin(scan(docs), "scan")
    both = _joined(scanned, "h", found_spans(scanned, discovered(scanned)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    more = F.coalesce("_tm_more", none)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_found"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by the first one's."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_chars`` (if any) counted again. All rows stay."""
    scanned = pin(scan(docs), "scan")
    marked = docs.withColumn("_tm_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = _joined(marked, "_tm_h", found_spans(scanned, discovered(scanned))).select(*docs.columns, "_tm_more")
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, more = batch.column("text").to_pylist(), batch.column("_tm_more").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, text in enumerate(texts):
                if text and ("@" in text or _DIGITS.search(text)):
                    spans = fixed_spans(text) + [(s["start"], s["kind"], s["end"]) for s in more[i] or ()]
                    if spans:
                        texts[i] = redact_text(text, spans)
                        if sizes:
                            sizes[i] = len(texts[i])
            columns = [pa.array(texts, batch.column(c).type) if c == "text" else pa.array(sizes, batch.column(c).type) if c == "n_chars" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(run, docs.schema)
