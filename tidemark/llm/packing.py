"""Mixture-controlled packing by deficit round robin over source queues.

Each source is a queue of its documents' token ids. A window (sequence) of LENGTH ids takes from every queue its
target share; what a window cannot give a queue to the token is the queue's deficit, carried to the windows after
it. A queue that runs dry leaves its share to the others in proportion. The rule is evaluated in closed form: the
ids that a queue has been served after w windows are found by halving the windows' total down a tree of queues,
rounding at each node, so a deficit never exceeds the tree's depth and any task finds the cuts of its documents
from the queue totals alone. Deficits are thereby carried over windows and partitions with no sequential pass.

Default targets are the sources' shares of all ids, which keeps the mixture the same to the last window. Sources
below 1/MOST of all ids share POOLS queues by hash, so queues are bounded however many sources there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textblocks import lean
from tidemark.llm.tokens import encoder
from tidemark.session import pin

LENGTH = 2048
END_ID = 1
MOST, POOLS = 512, 64


def muldiv(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor(x * a / b) for 0 <= x <= b and 0 <= a <= b < 2**62, exactly; 0 where b is 0."""
    b = np.maximum(b, 1)
    q = (x.astype(np.longdouble) * a.astype(np.longdouble) / b.astype(np.longdouble)).astype(np.int64)
    rest = (x.astype(np.uint64) * a.astype(np.uint64) - q.astype(np.uint64) * b.astype(np.uint64)).view(np.int64)  # small, so right modulo 2**64
    return q + np.floor_divide(rest, b)


class Rule:
    """What every queue has been served after any number of ids."""

    def __init__(self, sizes: list[int], targets: list[float] | None = None):
        leaves = 1 << max(0, (len(sizes) - 1).bit_length())
        self.leaves, self.total = leaves, int(sum(sizes))
        size = np.zeros(leaves, np.int64)
        size[: len(sizes)] = sizes
        served = [np.zeros(leaves, np.int64)]
        if targets is not None:  # a phase ends when a queue runs dry
            want = np.zeros(leaves)
            want[: len(sizes)] = targets
            some = (want > 0) & (size > 0)
            for at in sorted(set((size[some] / want[some]).tolist())):
                now = np.where(some, np.minimum(size, np.floor(want * at + 1e-9).astype(np.int64)), 0)
                dry = some & (size / np.where(want > 0, want, 1) <= at)
                served.append(np.maximum(np.where(dry, size, now), served[-1]))
        served.append(size)  # queues without a target come last
        heap = np.zeros((len(served), 2 * leaves), np.int64)
        heap[:, leaves:] = np.stack(served)
        for node in range(leaves - 1, 0, -1):
            heap[:, node] = heap[:, 2 * node] + heap[:, 2 * node + 1]
        self.done, self.part, self.starts = heap[:-1], np.diff(heap, axis=0), heap[:, 1]

    def served(self, ids: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After ``ids`` ids: (ids of the queue, ids of the queues before it)."""
        ids = np.minimum(ids, self.total)
        phase = np.minimum(np.searchsorted(self.starts[1:], ids, "right"), len(self.part) - 1)
        left_of = np.zeros(len(ids), np.int64)
        x = ids - self.starts[phase]
        node = np.ones(len(ids), np.int64)
        leaf = queue + self.leaves
        for shift in range(self.leaves.bit_length() - 2, -1, -1):
            part = muldiv(x, self.part[phase, 2 * node], self.part[phase, node])
            right = (leaf >> shift) & 1
            left_of += np.where(right == 1, self.done[phase, 2 * node] + part, 0)
            x = np.where(right == 1, x - part, part)
            node = 2 * node + right
        return self.done[phase, leaf] + x, left_of

    def window(self, place: np.ndarray, queue: np.ndarray, length: int) -> np.ndarray:
        """The window that serves id ``place`` of the queue: the last with no more than ``place`` served before it."""
        low, high = np.zeros(len(place), np.int64), np.full(len(place), -(-self.total // length), np.int64)
        while (high - low > 1).any():
            middle = (low + high) // 2
            before = self.served(middle * length, queue)[0] <= place
            low, high = np.where(before, middle, low), np.where(before, high, middle)
        return low

    def pieces(self, start: np.ndarray, size: np.ndarray, queue: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(row, start in the row, length, window, offset in the window) of rows that lie at ``start`` of their queues."""
        first = self.window(start, queue, length)
        n = self.window(start + size - 1, queue, length) - first + 1
        row = np.repeat(np.arange(len(n)), n)
        window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        low, low_left = self.served(window * length, queue[row])
        high, high_left = self.served((window + 1) * length, queue[row])
        begin, end = np.maximum(low, start[row]), np.minimum(high, (start + size)[row])
        some = end > begin
        offset = high_left - low_left + begin - low
        return tuple(x[some] for x in (row, begin - start[row], end - begin, window, offset))


def _tokens(docs: DataFrame, definition: str, kind: str, end_id: int) -> DataFrame:
    """Ids of each row, its task, and the ids of the same source before it in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer's file

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, sofar = encoder(shared.value, kind), TaskContext.get().partitionId(), {}
        end = np.array([end_id], tool.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                raw = [x + end for x in tool.ids([t or "" for t in some.column("text").to_pylist()])]
                sizes = [len(x) // tool.dtype.itemsize for x in raw]
                before = []
                for source, n in zip(some.column("source").to_pylist(), sizes):
                    before.append(sofar.get(source, 0))
                    sofar[source] = before[-1] + n
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("source"), pa.array([task] * len(raw), pa.int32()), pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "source", "task", "before", "doc_tokens", "ids"])
        tool.rest()

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, source string, task int, before bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, definition: str, kind: str = "plain", end_id: int = END_ID, length: int = LENGTH,
         targets: Mapping[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    ``targets`` are weights of sources (those not named come after the others); by default each source's share
    of all ids. Null and empty texts are one end id; null and empty sources are one queue; repeated rows are
    packed as often as they come; other columns are not read. Every window is full but the last, which is padded
    to ``length`` (``padded_to``) unless its size is a power of two.
    """
    spark = docs.sparkSession
    tokens = pin(_tokens(docs, definition, kind, end_id), "tokens")
    sums = tokens.groupBy("task", "source").agg(F.sum("doc_tokens").alias("n"))
    sums = pin(sums, "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    named = sorted(targets) if targets else []
    large = {r.source: r.n for r in by_source.where((F.col("n") * MOST >= total) | F.col("source").isin(named)).collect()}
    names = sorted(large)
    pool = F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(POOLS)).cast("int")
    queue = pool
    if names:
        queue = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)]), F.col("source")), pool)
    sums = sums.withColumn("queue", queue)
    sizes = [0] * (len(names) + POOLS)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        sizes[r["queue"]] = r.n
    weights = [float(targets.get(s, 0)) for s in names] + [0.0] * POOLS if targets else None
    rule = spark.sparkContext.broadcast(Rule(sizes, weights))  # at most MOST + POOLS queues
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("task", "source", "queue", F.coalesce(earlier, F.lit(0).cast("long")).alias("base"))
    placed = tokens.join(bases, ["task", "source"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, last = rule.value, rule.value.total // length
        rest = rules.total - last * length
        tail = rest if rest & (rest - 1) == 0 else length
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                size = some.column("doc_tokens").to_numpy()
                row, start, n, window, offset = rules.pieces(some.column("at").to_numpy(), size, some.column("queue").to_numpy().astype(np.int64), length)
                raw = some.column("ids").to_pylist()
                wide = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").tobytes() for x, k in zip(raw, size.tolist())]
                crc = [zlib.crc32(wide[r][4 * x : 4 * (x + k)]) for r, x, k in zip(row.tolist(), start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), pa.array(size[row]),
                    pa.array(window), pa.array(offset), pa.array(np.where(window < last, length, tail))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_to bigint")
