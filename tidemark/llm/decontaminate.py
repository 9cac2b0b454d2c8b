"""Benchmark decontamination: size-partitioned MinHash containment search with an exact check.

Short test items are looked for inside documents of any length. Items are partitioned by their number of
five-word shingles into size classes (1, 2], (2, 4], (4, 8], ... A document is cut, per class, into blocks of
half the class's size, and each block gets a MinHash of COORDINATES values. An item that lies in a document
fills most of some block, so the block has the item's own minimum at a coordinate with a probability of about
a half or more; a document is a candidate as soon as one block agrees at one coordinate. Candidates are then
checked on their whole shingle sets. An item wholly contained is overlooked with probability below 1e-6, one
contained by 0.8 below 1e-5.

Documents are not shuffled: the items' minima are broadcast, in passes of at most ITEM_SHINGLES shingles, and
each document is searched where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textblocks import blocks, lean, mix, shingles, words
from tidemark.session import pin

SHINGLE = 5  # words
CONTAINMENT = 0.8  # of an item's distinct shingles
COORDINATES = 24
ITEM_SHINGLES = 1 << 20  # broadcast at a time: 8 bytes each, and as much again for the index

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def _minhash(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    return ((values * factor) >> np.uint64(32)).astype(np.uint32)


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text")):
            values, doc = shingles(*words(data, ends), SHINGLE)
            starts = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(starts), pa.array(values.view(np.int64)))],
                ["item_id", "shingles"])


class Index:
    """Minima of a set of items, by size class and coordinate."""

    def __init__(self, item_id: list, sets: list[np.ndarray]):
        self.item_id = np.array(item_id, object)
        self.sets = [np.unique(s) for s in sets]
        sizes = np.array([len(s) for s in self.sets])
        self.classes = {}
        level = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1))), 1).astype(int)
        for c in np.unique(level):
            items = np.flatnonzero(level == c)
            tables = []
            for factor in _FACTORS:
                low = np.array([_minhash(self.sets[i], factor).min() for i in items], np.uint32)
                order = np.argsort(low, kind="stable")
                maybe = np.zeros(1 << 16, bool)
                maybe[low & 0xFFFF] = True
                tables.append((low[order], items[order], maybe))
            self.classes[int(c)] = tables

    def search(self, values: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, shared shingles, item's shingles) of contained items; documents delimited by ``at``."""
        found = set()
        if len(values) == 0 or not self.classes:
            return []
        docs = np.arange(len(at) - 1)
        layouts, before, size_before = {}, at, 1  # per class: how its blocks lie on those of the class before
        for c in sorted(self.classes):
            step = (1 << (c - 1)) // size_before
            n = np.diff(before)
            blocks_of = -(-n // step)
            after = np.concatenate([[0], np.cumsum(blocks_of)])
            doc = np.repeat(docs, blocks_of)
            start = before[:-1][doc] + (np.arange(len(doc)) - after[:-1][doc]) * step
            layouts[c] = (step, start, doc)
            before, size_before = after, 1 << (c - 1)
        for j, factor in enumerate(_FACTORS):
            low = _minhash(values, factor)
            for c, (step, start, doc) in layouts.items():
                if step > 1:
                    low = np.minimum.reduceat(low, start)
                mins, items, maybe = self.classes[c][j]
                hit = np.flatnonzero(maybe[low & np.uint32(0xFFFF)])
                first, last = (np.searchsorted(mins, low[hit], side) for side in ("left", "right"))
                for h, x, y in zip(hit[last > first], first[last > first], last[last > first]):
                    found.update((int(doc[h]), int(i)) for i in items[x:y])
        out, known, of = [], None, -1
        for d, i in sorted(found):
            if d != of:
                known, of = np.unique(values[at[d] : at[d + 1]]), d
            place = np.minimum(np.searchsorted(known, self.sets[i]), len(known) - 1)
            shared = int((known[place] == self.sets[i]).sum())
            if shared >= CONTAINMENT * len(self.sets[i]):
                out.append((d, i, shared, len(self.sets[i])))
        return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items that have a word, in parts of about ITEM_SHINGLES shingles."""
    rows = benchmark.select("item_id", F.col("text").cast("string")).where("text is not null")
    sets = pin(rows.mapInArrow(_item_sets, "item_id bigint, shingles array<bigint>").where("size(shingles) > 0"), "items")
    parts = 1 + (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) // ITEM_SHINGLES
    for part in range(parts):
        got = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(parts)) == part).toArrow()
        if got.num_rows:
            yield Index(got["item_id"].to_pylist(), [np.array(s, np.int64).view(np.uint64) for s in got["shingles"].to_pylist()])


def _found(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int]]:
    for lo, _, data, ends in blocks(column):
        values, doc = shingles(*words(data, ends), SHINGLE)
        at = np.searchsorted(doc, np.arange(len(ends)))
        yield from ((lo + d, i, shared, size) for d, i, shared, size in index.search(values, at))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, shared, item_shingles, containment.

    A text of fewer than five words is one shingle: such an item is found only in documents of just its words.
    Null or wordless items and documents match nothing; repeated rows of either side each give their rows;
    columns other than id and text are not read.
    """
    kind = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint, containment double"
    rows, out = docs.select("doc_id", F.col("text").cast("string")), None
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(_found(batch.column("text"), shared.value))
                d, i, n, size = (np.array([g[k] for g in got], np.int64) for k in range(4))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(d)), pa.array(list(shared.value.item_id[i]), pa.int64()), pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1))],
                    ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        part = rows.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _, _, _ in _found(batch.column("text"), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
