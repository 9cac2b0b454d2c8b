"""Periodic runs of words, found in overlapping tiles of every scale.

A run of period q and length 3 q or more holds a stretch of at least 2 q places whose word equals the word q places
on. Periods are handled by octave: for those in [T, 2 T) (the first octave also takes all shorter ones) every such
stretch covers [b, b + T) for some boundary b, a multiple of T. So a document is exploded, octave by octave, into
overlapping tiles of boundaries, and a tile is solved on its own:

* boundaries with a period that holds on all of [b, b + T) are picked by comparing rolling hashes;
* Z-functions of the words around such a boundary, forwards and backwards, verify the period on the words
  themselves and tell how far it reaches to either side;
* a period that is a multiple of a shorter one of the same words is left out there (a run with both would be a run of
  the shorter one all along, and each of its tiles sees that).

What a tile finds are interval fragments. They are shuffled by document and period, and fragments that touch are
stitched to runs. Tiles of a document of up to SPREAD words are solved in the task that reads it; those of a longer
one are rows of their own, dealt out over the cluster. Work is O(n log n) for a document of n words whatever they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textblocks import _powers, mix
from tidemark.session import pin

REPEATS, LEAST = 3, 24  # a run's length is at least REPEATS periods and LEAST words
STRIDE = 8  # boundaries of the first octave; with LEAST words every period below it covers two strides
TILE = 1 << 13  # words between a tile's first and last boundary, at least
SPREAD = 1 << 20  # words of a document whose tiles are solved where it is read

PARTS = ("uid bigint, doc_id bigint, words binary, collapsed_sha256 string, "
         "found array<struct<period:bigint,first:bigint,last:bigint>>, octaves array<bigint>, starts array<bigint>, tiles array<binary>")
FRAGMENT = "uid bigint, period bigint, first bigint, last bigint"


def z_function(s: list) -> list[int]:
    """For every place, how many words from there on equal the first ones."""
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def octaves(n: int) -> Iterator[int]:
    """Strides whose periods can have a run among n words."""
    stride = STRIDE
    while stride == STRIDE or REPEATS * stride <= n:
        yield stride
        stride *= 2


def tiles(n: int, stride: int) -> Iterator[tuple[int, int]]:
    """(first boundary, end of boundaries) of a document's tiles."""
    step = max(TILE, 8 * stride)
    return ((at, min(at + step, n)) for at in range(0, n, step))


def picked(ids: np.ndarray, first: int, end: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) where the ``stride`` words at the boundary come again a period later, by hash."""
    power, inverse = _powers(len(ids))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * power, out=total[1:])
    window = (total[stride:] - total[:-stride]) * inverse[: len(ids) - stride + 1]
    at = np.repeat(window[first:end:stride], stride)
    out = []
    for shift in (0, stride) if stride == STRIDE else (stride,):
        later = window[first + shift : first + shift + len(at)]
        x = np.flatnonzero(later == at[: len(later)])
        q = x % stride + shift
        out.append((first + x - x % stride, q))
    b, q = (np.concatenate(x) for x in zip(*out))
    return b[q > 0], q[q > 0]


def solve(ids: np.ndarray, first: int, end: int, stride: int) -> list[tuple[int, int, int]]:
    """(period, first place, end of places) of the stretches in a tile whose words come again a period later.

    ``ids`` are the tile's words, equal numbers for equal words: up to a stride before the boundary ``first`` and four
    strides behind ``end``. Neighbouring fragments of a period are joined already.
    """
    if len(ids) < stride + 1 or first >= len(ids):
        return []
    boundary, period = picked(ids, first, end, stride)
    if not len(boundary):
        return []
    order = np.lexsort((period, boundary))
    boundary, period = boundary[order], period[order]
    words, open_, out = ids.tolist(), {}, []
    cuts = np.flatnonzero(np.diff(boundary)) + 1
    for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(boundary)])).tolist()):
        b, periods = int(boundary[lo]), period[lo:hi].tolist()
        ahead = z_function(words[b : b + 4 * stride])
        reach, least = [0], 0  # how far one of the periods up to a length holds
        for d in range(1, min(stride, len(ahead) - 1) + 1):
            least = max(least, d + ahead[d])
            reach.append(least)
        behind = None
        for q in periods:
            if ahead[q] < stride or reach[min(q - 1, len(reach) - 1)] >= stride + q:
                continue  # not the same words after all, or a multiple of a shorter period
            before = open_.get(q)
            if before is not None and before[1] >= b:
                before[1] = max(before[1], b + ahead[q])
                continue
            if before is not None:
                out.append((q, *before))
            if behind is None:
                back = words[max(0, b - stride) : b][::-1]
                behind = z_function([*back, -1, *words[max(0, b - stride) : b + 2 * stride][::-1]])
                ends = min(len(words), b + 2 * stride)
            # the reversed words before b + q begin there in the text behind the mark
            back_by = min(behind[len(back) + 1 + ends - (b + q)], stride) if b + q <= ends and back else 0
            open_[q] = [b - back_by, b + ahead[q]]
    return out + [(q, *x) for q, x in open_.items()]


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic stretch that a tenth of the documents get, by crc32 of the id (none without id)."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word only."""
    known = {}
    return np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))


def _whole(ids: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for stride in octaves(len(ids)):
        for lo, hi in tiles(len(ids), stride):
            base = max(0, lo - stride)
            out += [(q, base + s, base + e) for q, s, e in solve(ids[base : hi + 4 * stride], lo - base, hi - base, stride)]
    return out


_PART_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])),
               pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
_PART_NAMES = ["uid", "doc_id", "words", "collapsed_sha256", "found", "octaves", "starts", "tiles"]
FLUSH = 1 << 22  # bytes of words and tiles in a batch that is handed on


def _part(uid: int, doc_id: int | None, words: list[bytes]) -> tuple[tuple, int]:
    """The row of a document, and its bytes."""
    ids, joined = _numbered(words), b" ".join(words)
    spread = len(words) > SPREAD
    found = [] if spread else [{"period": q, "first": s, "last": e} for q, s, e in _whole(ids)]
    cut = [(t, lo, ids[max(0, lo - t) : hi + 4 * t].tobytes()) for t in octaves(len(ids)) for lo, hi in tiles(len(ids), t)] if spread else []
    held = joined if found or spread else None
    return (uid, doc_id, held, hashlib.sha256(joined).hexdigest(), found, *([c[i] for c in cut] for i in range(3))), len(held or b"") + 12 * len(ids) * len(cut)


def _read(change: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(_PART_TYPES), _PART_TYPES)], _PART_NAMES)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for row, (doc_id, uid) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist())):
                words = (texts[row].as_py() or b"").split()  # ASCII white space
                part, size = _part(uid, doc_id, altered(words, doc_id) if change else words)
                rows.append(part)
                weight += size
                if weight >= FLUSH or len(rows) >= 4096:
                    yield flushed()
                    rows, weight = [], 0
        yield flushed()

    return read


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, stride, lo, tile in zip(*(batch.column(c).to_pylist() for c in ("uid", "octave", "lo", "tile"))):
            ids, base = np.frombuffer(tile, np.int64), max(0, lo - stride)
            got = [(q, base + s, base + e) for q, s, e in solve(ids, lo - base, min(lo - base + max(TILE, 8 * stride), len(ids)), stride)]
            yield pa.RecordBatch.from_arrays([pa.array([uid] * len(got), pa.int64()), *[pa.array(list(c), pa.int64()) for c in (zip(*got) if got else [()] * 3)]],
                                             ["uid", "period", "first", "last"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (uid, start, length, period) from the fragments of each document and period, joined where they touch."""
    order = Window.partitionBy("uid", "period").orderBy("first", "last")
    gap = F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    parts = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("uid", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    runs = whole.select("uid", "start", (F.col("last") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where((F.col("length") >= LEAST) & (F.col("length") >= REPEATS * F.col("period")))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
    for batch in batches:
        rows = []
        for doc_id, plain, words, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "collapsed_sha256", "words", "runs"))):
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs or [])
            listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, p, n in runs).encode()).hexdigest()
            if not runs:
                rows.append((doc_id, 0, None, None, None, None, listed, plain, words))
                continue
            start, period, length = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]))
            words = words.split(b" ")
            edge = np.zeros(len(words) + 1, np.int64)
            for s, p, n in runs:
                edge[s + p] += 1
                edge[s + n] -= 1
            kept = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
            rows.append((doc_id, len(runs), start, length, period, 1000 * length // period, listed, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names)


def collapsed(docs: DataFrame, change: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, runs). Documents are rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, collapsed) with the run of greatest exponent, and the words that no run repeats, joined by a
    blank (``collapsed``, as bytes; null for a document where nothing repeats, whose words are all kept). Runs are rows
    (uid, start, length, period), ``uid`` a number of the document's row.

    ``change`` first makes the tail of a tenth of the documents periodic, by their ids. Words are runs of characters
    other than ASCII white space, told apart exactly. A null or wordless text has no runs; a null id is no reason to
    drop a row or to change it. Repeated rows are rows of their own. Other columns are not read; an empty table gives
    no row. Work on one document's rows is bounded by its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    parts = pin(rows.mapInArrow(_read(change), PARTS), "parts")
    here = parts.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    dealt = parts.where(F.size("tiles") > 0).select("uid", F.posexplode("tiles").alias("at", "tile"), "octaves", "starts")
    dealt = dealt.select("uid", F.element_at("octaves", F.col("at") + 1).alias("octave"), F.element_at("starts", F.col("at") + 1).alias("lo"), "tile")
    there = dealt.repartition("uid", "octave", "lo").mapInArrow(_solved, FRAGMENT)
    runs = stitched(here.union(there))
    listed = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # no more than a document's words
    told = parts.select("uid", "doc_id", "words", "collapsed_sha256").join(listed, "uid", "left").drop("uid").mapInArrow(
        _told, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
               "runs_sha256 string, collapsed_sha256 string, collapsed binary")
    return told, runs


def periodic_runs(docs: DataFrame, change: bool = False) -> DataFrame:
    """``collapsed`` documents with digests in place of texts."""
    return collapsed(docs, change)[0].drop("collapsed")
