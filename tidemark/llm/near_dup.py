"""Near-duplicate classes by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles with their counts. DartMinHash throws darts at the plane of
(weight, rank) above every element; which darts there are follows from hashes of the element alone, so all
documents see the same ones. A document keeps the darts below its weights and, per signature coordinate, the
one of lowest rank. Two documents agree at a coordinate with the probability of their weighted Jaccard
similarity, sum of minima over sum of maxima, and the work is about (elements + coordinates * log coordinates)
per document.

From signatures to classes, without ever forming all pairs of a group:

1. rows of equal text are one node, found by digest;
2. signatures are cut into bands; nodes that share no band with another node are done;
3. rows of a band are range-partitioned and sorted by the rest of the signature, so hot bands split over tasks,
   and each row is compared with the next few in its band: all pairs of a small band, which is never cut, and
   the nearest ones of a large;
4. pairs whose signatures agree often enough are checked on their whole shingle sets: the two nearest of each
   node first, then those that still lie in different components;
5. large bands that still hold more than one component are compared in full on their shingle sets, in pairs of
   blocks, leaving out pairs within a component;
6. connected components of the verified links are the classes.

Empty texts (null, or without a word) are their own class each; equal wordless texts are not linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.textblocks import blocks, counted, lean, mix, shingles, words
from tidemark.session import pin

SHINGLE = 5  # words
SIMILARITY = 0.8
COORDINATES, BANDS, BAND_ROWS = 128, 25, 5  # a pair at 0.8 shares no band with probability 5e-5
NEIGHBOURS = 8  # rows ahead that a row is compared with in its band at first
BLOCK, BLOCK_MEMBERS = 512, 1 << 19  # rows, and set members, in a block of a large band
SLACK = 0.13  # 3.7 standard errors of the similarity that 128 coordinates estimate
NO_ID = -(1 << 63)

_STRIP, _THROW = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures n_docs x k of uint32, which documents have weight). Elements are distinct within a document.

    The weight axis above an element is cut into strips [0, 1), [1, 2), [2, 4), ... A strip of width a receives
    k * a darts per unit of rank; dart n of a strip has an exponential gap in rank, a place in the strip and a
    coordinate, all hashes of (element, strip, n). Darts are thrown up to a rank that fills all coordinates but
    rarely; documents that miss one go on to twice the rank.
    """
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, k), np.uint32)
    present = total > 0
    if not present.any():
        return out, present
    # strips of every element; most elements have weight 1 and one strip
    strips = np.where(weight > 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))), 1).astype(np.int64)
    item = np.repeat(np.arange(len(element)), strips)
    level = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    base = mix(element[item] + _STRIP * (level + 1).astype(np.uint64))
    owner, room = doc[item], weight[item] - low
    limit = np.where(present, (np.log(k) + 2.5) / np.where(present, total, 1), 0)
    best = np.full(n_docs * k, np.inf)
    flat = out.reshape(-1)
    open_ = present.copy()
    while open_.any():
        active = np.flatnonzero(open_[owner])
        rank, n = np.zeros(len(active)), 0
        darts = []
        while len(active):
            n += 1
            h = mix(base[active] + np.uint64(int(_THROW) * n % (1 << 64)))
            rank = rank - np.log(_uniform(h)) / (k * width[active])
            below = rank < limit[owner[active]]
            active, rank, h = active[below], rank[below], h[below]
            h = mix(h ^ _STRIP)
            hit = _uniform(mix(h)) * width[active] < room[active]
            darts.append((owner[active[hit]] * k + (h[hit] % np.uint64(k)).astype(np.int64), rank[hit], (h[hit] >> np.uint64(32)).astype(np.uint32)))
        cell, rank, name = (np.concatenate(x) for x in zip(*darts))
        np.minimum.at(best, cell, rank)
        won = best[cell] == rank
        flat[cell[won]] = name[won]
        open_ &= np.isinf(best.reshape(n_docs, k)).any(axis=1)
        limit = np.where(open_, limit * 2, limit)
    return out, present


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signatures), band + 1, np.uint64)
        for row in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = mix(key * _THROW + signatures[:, row])
        keys[:, band] = key
    return keys.view(np.int64)


SKETCH = "node binary, doc_id bigint, sig binary, keys array<bigint>"


@lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text")):
            hashes, at = words(data, ends)
            element, doc, count = counted(*shingles(hashes, at, SHINGLE), hi - lo)
            signatures, present = dart_minhash(element, doc, count.astype(np.float64), hi - lo, COORDINATES)
            rows = np.flatnonzero(present)
            keys = band_keys(signatures[rows]).reshape(-1)
            short = (signatures[rows] & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").slice(lo, hi - lo).take(pa.array(rows)),
                batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows)),
                pa.array([x.tobytes() for x in short], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys)),
            ], ["node", "doc_id", "sig", "keys"])


@lean
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each sorted row with the next NEIGHBOURS of its band; keeps that many rows between batches."""
    names, kind = ["a", "b", "alike"], pa.schema([("a", pa.binary()), ("b", pa.binary()), ("alike", pa.float32())])
    tail_key, tail_sig, tail_node = np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint8), np.zeros(0, object)
    for batch in batches:
        node = np.array(batch.column("node").to_pylist(), object)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        key, sig, node = (np.concatenate(x) for x in zip((tail_key, tail_sig, tail_node), (batch.column("key").to_numpy(), sig, node)))
        fresh, found = len(tail_key), []
        for step in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero(key[step:] == key[:-step])
            i = i[i + step >= fresh]  # the others were compared with the batch before
            alike = (sig[i] == sig[i + step]).mean(axis=1)
            good = alike >= SIMILARITY - SLACK
            found.append((i[good], i[good] + step, alike[good]))
        i, j, alike = (np.concatenate(x) for x in zip(*found))
        if len(i):
            first = np.array([x < y for x, y in zip(node[i], node[j])], bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(first, node[i], node[j]), pa.binary()), pa.array(np.where(first, node[j], node[i]), pa.binary()),
                pa.array(alike, pa.float32())], schema=kind)
        tail_key, tail_sig, tail_node = (x[-NEIGHBOURS:] for x in (key, sig, node))
    yield pa.RecordBatch.from_arrays([pa.array([], x.type) for x in kind], names)


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's weighted set as distinct 32-bit hashes: occurrence m of a shingle is an element of its own."""
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text")):
            hashes, at = words(data, ends)
            element, doc, count = counted(*shingles(hashes, at, SHINGLE), hi - lo)
            again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            members = (mix(np.repeat(element, count) + _STRIP * again.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
            starts = np.searchsorted(np.repeat(doc, count), np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(starts), pa.array(members.view(np.int32)))],
                ["node", "members"])


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with the digest of their text; a null text is empty, a null doc_id the lowest number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, node, band, large) of the bands that two nodes or more share; ``large`` ones hold more rows than are
    compared with one another in signature order."""
    spread = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy("key").count().where("count > 1").select("key", (F.col("count") > NEIGHBOURS + 1).alias("large"))
    return spread.join(shared, "key")


def candidates(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose signatures are alike: (a, b, alike). All of a small band, nearest ones of a large."""
    cut = F.col("band") * BAND_ROWS
    rotated = F.concat(F.expr(f"substring(sig, band * {BAND_ROWS} + 1)"), F.substring("sig", F.lit(1), cut))
    rows = rows.join(nodes.select("node", "sig"), "node").select("key", "node", rotated.alias("sig"), "large")
    within = [F.when(F.col("large"), F.col(c)) for c in ("sig", "node")]  # only large bands are cut
    ordered = rows.repartitionByRange("key", *within).sortWithinPartitions("key", "sig", "node").drop("large")
    pairs = ordered.mapInArrow(_neighbours, "a binary, b binary, alike float")
    return pairs.groupBy("a", "b").agg(F.max("alike").alias("alike"))


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs with a weighted Jaccard similarity of SIMILARITY or more on their whole sets."""
    left = members.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = members.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(both >= SIMILARITY * either).select("a", "b")


def _linked(table: pa.Table) -> pa.Table:
    """Links between the components of two blocks of a band, or within one: as many as join what can be joined."""
    node, sets = table.column("node").to_pylist(), table.column("members").combine_chunks()
    members, starts = sets.flatten().to_numpy(), sets.offsets.to_numpy().astype(np.int64)
    starts, size = starts - starts[0], np.diff(starts)
    label = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
    block = table.column("block").to_numpy()
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    names, members = np.unique(members, return_inverse=True)
    marked, found = np.zeros(len(names), bool), []
    for p in range(len(node) - 1):
        rest = np.arange(p + 1, len(node))
        fits = (label[rest] != label[p]) & (size[rest] >= SIMILARITY * size[p]) & (size[p] >= SIMILARITY * size[rest])
        rest = rest[fits if same else fits & (block[rest] != block[p])]
        if not len(rest):
            continue
        marked[members[starts[p] : starts[p + 1]]] = True
        ends = np.cumsum(size[rest])
        picked = np.repeat(starts[rest] - ends + size[rest], size[rest]) + np.arange(ends[-1])
        both = np.add.reduceat(marked[members[picked]], ends - size[rest], dtype=np.int64)
        marked[members[starts[p] : starts[p + 1]]] = False
        for q in rest[both >= SIMILARITY * (size[p] + size[rest] - both)].tolist():
            if label[q] != label[p]:
                found.append((min(node[p], node[q]), max(node[p], node[q])))
                label[label == label[q]] = label[p]
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def across(rows: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within large bands, from all pairs of their rows.

    A band is cut into blocks by the hash of the node; every two blocks meet in a task.
    """
    placed = rows.where("large").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = placed.join(members.select("node", F.size("members").alias("size")), "node")
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_MEMBERS)).cast("int")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks_of.alias("n")).where("low != high").select("key", "n")
    cut = placed.join(mixed, "key").select("key", "node", "root", "n", F.pmod(F.xxhash64("node"), "n").cast("int").alias("block"))
    met = cut.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("key", F.least("block", "y").alias("i"), F.greatest("block", "y").alias("j"), "block", "node", "root")
    return met.join(members, "node").groupBy("key", "i", "j").applyInArrow(_linked, "a binary, b binary").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows are (doc_id, node) of each document; nodes (node, doc_id, copies, links, class_node, class_id).

    ``doc_id`` of a node is the lowest of its copies; ``class_id`` the lowest of its class; ``links`` counts the
    class's verified links at the node.
    """
    rows = _identified(docs)
    worded = rows.mapInArrow(_sketches, SKETCH)
    nodes = pin(worded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"),
                                           F.first("keys").alias("keys")), "nodes")
    bands = pin(shared_bands(nodes), "bands")
    pairs = pin(candidates(bands, nodes), "pairs")
    wanted = pairs.select("a").union(pairs.select("b")).union(bands.where("large").select("node")).distinct().toDF("node").join(nodes.select("node", "doc_id"), "node")
    texts = rows.join(wanted, ["node", "doc_id"], "left_semi")
    members = pin(texts.mapInArrow(_sets, "node binary, members array<int>").dropDuplicates(["node"]), "members")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "alike")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("alike"), "a", "b"))
    nearest = pin(ends.withColumn("r", rank).where("r <= 2").select("a", "b").distinct(), "nearest")
    links = pin(verified(nearest, members), "links")
    roots = components(links)
    apart = pairs.join(nearest, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        apart = apart.join(roots.toDF(end, f"root_{end}"), end, "left")
    apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = pin(links.union(verified(apart, members)), "links")
    roots = components(links)
    more = pin(across(bands, roots, members), "across")
    if not more.isEmpty():
        links = pin(links.union(more), "links")
        roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = nodes.select("node", "doc_id", "copies").join(roots, "node", "left").join(degree, "node", "left").select(
        "node", "doc_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("root", F.col("m.doc_id").alias("class_id"), F.col("m.node").alias("class_node"))
    known = pin(known.join(least, "root").drop("root"), "classes")
    return rows.select("doc_id", "node"), known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (lowest doc_id of its class), copies (rows of the same text),
    links (verified links of the text to other texts), kept (it is the one that stays).

    Extra columns are not read. Rows repeated with their id are all marked kept if their id is; null ids stay null.
    """
    rows, nodes = classes(docs)
    at = rows.join(nodes.withColumnRenamed("doc_id", "first_id"), "node", "left")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return at.select(
        real("doc_id").alias("doc_id"),
        F.when(F.col("class_id").isNull(), real("doc_id")).otherwise(real("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("class_node")), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one of each class: the row of lowest doc_id, all columns as they were.

    Wordless texts all stay. Repeats of the kept row (same doc_id, same text) go too.
    """
    _, nodes = classes(docs)
    keep = nodes.where("node = class_node").select(F.col("node").alias("_tm_node"), F.col("doc_id").alias("_tm_id"))
    marked = docs.withColumns({"_tm_node": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))),
                               "_tm_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})
    with_words = marked.join(keep, ["_tm_node", "_tm_id"]).dropDuplicates(["_tm_node", "_tm_id"])
    wordless = marked.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"))
    return with_words.select(docs.columns).unionByName(wordless.select(docs.columns))
