"""Language-model scores by logistic mixing of hashed-context bit predictors.

The model predicts a text byte by byte and each byte bit by bit. For every order 1 to 5 the bytes before and the
bits so far are hashed to a slot with two counts, of zeros and ones, over all training documents. The orders'
log-odds, plain and scaled by their evidence, are mixed by a logistic unit whose weights are chosen by a gate (the
highest order that has been seen, and the bit's place); the mix is then refined by an adaptive map of (byte before,
probability) to probability. Weights and map are learnt from every bit of every training text, its own count left
out; then they are frozen, so a text's score depends on nothing but the text and the model. A text's cost in bits
includes an end byte.

Counting is distributed: tasks reduce their documents to distinct six-byte grams and word hashes with counts, which
Spark sums. Slots are bounded (SLOTS), so the model can be broadcast; words are not, so those beyond the FREQUENT
most frequent meet their counts in a join.

So is learning. All that the mixer sees of a bit follows from the gram it ends in, so sums over the distinct grams,
each as often as it occurs, are sums over all bits of all training texts. A gate's weights are those of least cost,
found in Newton rounds: tasks add up cost, gradient and curvature over their grams, Spark adds up the tasks, the
driver solves for the next weights. The map is the least-squares fit to the mixed bits, from one more such pass.

Words are told apart by 64-bit hashes; among V distinct ones two share a hash with probability V * V / 2**65.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import fold
from tidemark.llm.textblocks import _powers, blocks, lean, mix
from tidemark.session import pin

ORDERS = 5
SLOTS = (1 << 16, 1 << 18, 1 << 20, 1 << 22, 1 << 22)  # per order
FREQUENT = 1 << 18  # most words whose counts are broadcast, 16 bytes each
GATES = (ORDERS + 1) * 8
INPUTS = 2 * ORDERS + 1  # of the logistic unit
PRIOR = 4.0  # how firmly weights and map are held where they start: as by so many bits
SETTLED = 1e-6  # nats a bit: a gate whose next step saves no more has its weights
CELLS = 33  # of the adaptive map, over log-odds -8 to 8
HELD = 1 << 19  # distinct keys a task holds before it passes counts on
MEMORY = 1 << 21  # grams whose cost a worker remembers
CHUNK = 1 << 15  # grams whose bits are held at a time

_OFFSET = np.concatenate([[0], np.cumsum(SLOTS)])[:-1]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (no ASCII white space, A-Z lowered), and where each document's begin and end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, stop = ends[:-1][ends[:-1] < n], ends[1:][ends[1:] > 0] - 1
    first[begin], last[stop] = inside[begin], inside[stop]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mix((total[last + 1] - total[first]) * inverse[first]), np.searchsorted(first, ends)


def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per byte and end byte, itself (lowest 8 bits) and the five before it, zeros before the text's begin."""
    closed = np.insert(data, ends[1:], 0).astype(np.int64)
    start = ends[:-1] + np.arange(len(ends) - 1)
    place = np.arange(len(closed)) - np.repeat(start, np.diff(ends) + 1)
    out = closed.copy()
    for j in range(1, ORDERS + 1):
        back = np.zeros(len(closed), np.int64)
        back[j:] = closed[:-j]
        out |= np.where(place >= j, back, 0) << (8 * j)
    return out


def slots(gram: np.ndarray, orders: Sequence[int] = range(ORDERS)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the bits of the last byte, highest first: (place, the slot of each order (rows x orders), the bit).
    Order 0 here is a context of one byte, and so on."""
    byte = gram & 0xFF
    contexts = [mix(((gram >> 8) & ((1 << (8 * (o + 1))) - 1)).astype(np.uint64) * np.uint64(8) + np.uint64(o + 1)) for o in orders]
    for place in range(8):
        node = ((1 << place) | (byte >> (8 - place))).astype(np.uint64)
        at = np.empty((len(gram), len(contexts)), np.int64)
        for column, o in enumerate(orders):
            spot = mix(contexts[column] + node * np.uint64(0x9E3779B97F4A7C15)) if o else ((gram >> 8) & 0xFF).astype(np.uint64) * np.uint64(256) + node
            at[:, column] = (spot % np.uint64(SLOTS[o])).astype(np.int64) + _OFFSET[o]
        yield place, at, (byte >> (7 - place)) & 1


class _Sums:
    """Counts of keys, passed on when too many are held."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held < 4 * HELD:
            return None
        keys, counts = self.merged()
        if len(keys) >= HELD:
            self.__init__()
            return keys, counts
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, key, n): grams are what 0, words what 1."""
    sums = (_Sums(), _Sums())

    def rows(what: int, got: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), what, np.int32)), pa.array(got[0]), pa.array(got[1])], ["what", "key", "n"])

    for batch in batches:
        for _, _, data, ends in blocks(batch.column("text")):
            for what, keys in ((0, grams(data, ends)), (1, word_hashes(data, ends)[0].view(np.int64))):
                full = sums[what].add(*np.unique(keys, return_counts=True))
                if full:
                    yield rows(what, full)
    for what in (0, 1):
        yield rows(what, sums[what].merged())


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with counts to slots with counts of zeros and ones; one order's slots are held at a time."""

    def counted(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for order in range(ORDERS):
            count = np.zeros((2, SLOTS[order]), np.int64)
            for lo in range(0, len(gram), 1 << 16):
                some, times = gram[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)]
                for _, at, bit in slots(some, [order]):
                    for value in (0, 1):
                        np.add.at(count[value], at[bit == value, 0] - _OFFSET[order], times[bit == value])
            used = np.flatnonzero(count.any(axis=0))
            for lo in range(0, len(used), 1 << 18):
                u = used[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((u + _OFFSET[order]).astype(np.int32)), pa.array(count[0, u]), pa.array(count[1, u])],
                                                 ["slot", "zeros", "ones"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= 2 * HELD:
            yield from counted(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield from counted(*map(np.concatenate, zip(*held)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.05)) / (zeros + np.float32(0.05)))


def _evidence(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + np.float32(1)) / 10, 1)


def _inputs(place: int, odds: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = (evidence > 0) * np.arange(1, ORDERS + 1)
    return np.hstack([odds, odds * evidence, np.full((len(odds), 1), 0.3)]), seen.max(axis=1) * 8 + place


def _cells(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the map that each log-odds falls into, and the share of the next one."""
    spot = (np.clip(mixed, -7.999, 7.999) + 8) * (CELLS - 1) / 16
    cell = spot.astype(np.int64)
    return cell, spot - cell


def _others(counts: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, gate, bit) of the bits of the last byte: what the counts say without the bit's own."""
    for place, at, bit in slots(gram):
        pair = counts[at]
        z = np.maximum(pair[:, :, 0] - (bit == 0)[:, None], 0).astype(np.float32)
        o = np.maximum(pair[:, :, 1] - (bit == 1)[:, None], 0).astype(np.float32)
        yield *_inputs(place, _odds(z, o), _evidence(z + o)), bit


def _mixing_sums(weight: np.ndarray, counts: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per gate: bits, their cost in nats with these weights, its gradient and its curvature."""
    out = np.zeros((GATES, 2 + INPUTS + INPUTS * INPUTS))
    for inputs, gates, bit in _others(counts, gram):
        for gate in np.unique(gates):
            rows = gates == gate
            x, y, times = inputs[rows], bit[rows], n[rows]
            mixed = x @ weight[gate]
            p = 1 / (1 + np.exp(-np.clip(mixed, -40, 40)))
            out[gate, 0] += times.sum()
            out[gate, 1] += times @ np.logaddexp(0, np.where(y == 1, -mixed, mixed))
            out[gate, 2 : 2 + INPUTS] += (times * (p - y)) @ x
            out[gate, 2 + INPUTS :] += ((x * (times * p * (1 - p))[:, None]).T @ x).ravel()
    return out


def _map_sums(weight: np.ndarray, counts: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per byte before and cell, over the bits mixed with these weights: squared shares, products with the share of
    the next cell, and shares of ones."""
    out = np.zeros((3, 256 * CELLS))
    for inputs, gates, bit in _others(counts, gram):
        cell, share = _cells(np.clip((weight[gates] * inputs).sum(axis=1), -12, 12))
        spot = ((gram >> 8) & 0xFF) * CELLS + cell
        for to, part in ((spot, 1 - share), (spot + 1, share)):
            out[0] += np.bincount(to, n * part * part, 256 * CELLS)
            out[2] += np.bincount(to, n * part * bit, 256 * CELLS)
        out[1] += np.bincount(spot, n * share * (1 - share), 256 * CELLS)
    return out


Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]  # of counts, grams, and how often each occurs
Totals = Callable[[Sums, tuple[int, ...]], np.ndarray]  # such sums, of this shape, over all that is learnt from


def _mixing_weights(totals: Totals) -> np.ndarray:
    """Of least cost, gate by gate: Newton steps, halved where the cost did not fall."""
    start = np.zeros((GATES, INPUTS))
    start[:, :ORDERS] = 0.25
    best, step, least, gain = start.copy(), np.zeros_like(start), np.full(GATES, np.inf), np.full(GATES, np.inf)
    while True:
        weight = best + step
        sums = totals(partial(_mixing_sums, weight), (GATES, 2 + INPUTS + INPUTS * INPUTS))
        cost = sums[:, 1] + PRIOR / 2 * ((weight - start) ** 2).sum(axis=1)
        gradient = sums[:, 2 : 2 + INPUTS] + PRIOR * (weight - start)
        newton = -np.linalg.solve(sums[:, 2 + INPUTS :].reshape(GATES, INPUTS, INPUTS) + PRIOR * np.eye(INPUTS), gradient[:, :, None])[:, :, 0]
        fell = cost < least
        best[fell], least[fell] = weight[fell], cost[fell]
        step = np.where(fell[:, None], newton, step / 2)
        gain = np.where(fell, -(gradient * newton).sum(axis=1) / 2, gain / 2)
        if (gain <= SETTLED * (sums[:, 0] + 1)).all():
            return np.round(best, 6)  # so that the order in which tasks are added up seldom shows


def _fitted_map(squares: np.ndarray, products: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probabilities per byte before and cell, read by interpolation, that miss the bits by the least squares."""
    at = np.arange(CELLS)
    system = np.zeros((256, CELLS, CELLS))
    system[:, at, at] = squares.reshape(256, CELLS) + PRIOR
    system[:, at[:-1], at[1:]] = system[:, at[1:], at[:-1]] = products.reshape(256, CELLS)[:, :-1]
    right = ones.reshape(256, CELLS) + PRIOR * _squash(np.linspace(-8, 8, CELLS))
    return np.clip(np.round(np.linalg.solve(system, right[:, :, None])[:, :, 0], 9), 1e-4, 1 - 1e-4)


def _added(work: Sums, counts: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sum(work(counts, gram[lo : lo + CHUNK], n[lo : lo + CHUNK].astype(np.float64)) for lo in range(0, len(gram), CHUNK))


class _Counts:
    """Counts of zeros and ones per slot. Most are small, so they travel, and lie on the executors' disks, deflated."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def __getstate__(self) -> bytes:
        return zlib.compress(self.counts, 1)

    def __setstate__(self, state: bytes) -> None:
        self.counts = np.frombuffer(zlib.decompress(state), np.int32).reshape(-1, 2)


def _totals(rows: DataFrame, told: Broadcast) -> Totals:
    """Over a table of distinct grams (key) and how often each occurs (n)."""

    def totals(work: Sums, shape: tuple[int, ...]) -> np.ndarray:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, held, size = np.zeros(shape), [], 0
            for batch in batches:
                held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
                size += batch.num_rows
                if size >= CHUNK:
                    out += _added(work, told.value.counts, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if size:
                out += _added(work, told.value.counts, *map(np.concatenate, zip(*held)))
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out.ravel()[at])], ["at", "value"])

        got = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # at most the shape's
        out = np.zeros(shape)
        out.ravel()[got["at"].to_numpy()] = got["value"].to_numpy()
        return out

    return totals


class Model:
    """Log-odds and evidence per slot, mixing weights per gate, and the adaptive map.

    Learns from all that ``totals`` adds up, or without it from texts at hand.
    """

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, texts: Sequence[bytes] = (), totals: Totals | None = None):
        self.key = uuid.uuid4().hex
        if totals is None:
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            gram, n = np.unique(grams(np.frombuffer(b"".join(texts), np.uint8), ends), return_counts=True)
            counts = np.stack([zeros, ones], axis=1)
            totals = lambda work, shape: np.zeros(shape) + _added(work, counts, gram, n)
        self.weight = _mixing_weights(totals)
        self.map = _fitted_map(*totals(partial(_map_sums, self.weight), (3, 256 * CELLS)))
        self.odds, self.evidence = np.empty(len(zeros), np.float16), np.empty(len(zeros), np.float16)
        for lo in range(0, len(zeros), 1 << 20):
            z, o = zeros[lo : lo + (1 << 20)].astype(np.float32), ones[lo : lo + (1 << 20)].astype(np.float32)
            self.odds[lo : lo + (1 << 20)], self.evidence[lo : lo + (1 << 20)] = _odds(z, o), _evidence(z + o)

    def _refine(self, mixed: np.ndarray, before: np.ndarray) -> np.ndarray:
        cell, share = _cells(mixed)
        return (_squash(mixed) + self.map[before, cell] * (1 - share) + self.map[before, cell + 1] * share) / 2

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each gram costs."""
        out = np.zeros(len(gram))
        before = (gram >> 8) & 0xFF
        for place, at, bit in slots(gram):
            x, gate = _inputs(place, self.odds[at].astype(np.float64), self.evidence[at].astype(np.float64))
            p = self._refine(np.clip((self.weight[gate] * x).sum(axis=1), -12, 12), before)
            out -= np.log2(np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1))
        return out


class _Costs:
    """A model with the costs of the grams a worker has met."""

    current: _Costs | None = None

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.bits = np.full(MEMORY, -1, np.int64), np.zeros(MEMORY, np.float64)

    @classmethod
    def of(cls, model: Model) -> _Costs:
        if cls.current is None or cls.current.model.key != model.key:
            cls.current = cls(model)
        return cls.current

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        place = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self.bits[place]
        new = np.flatnonzero(self.keys[place] != gram)
        if len(new):
            missing, back = np.unique(gram[new], return_inverse=True)
            bits = np.concatenate([self.model.cost(missing[lo : lo + (1 << 15)]) for lo in range(0, len(missing), 1 << 15)])
            out[new] = bits[back]
            self.keys[place[new]], self.bits[place[new]] = gram[new], out[new]
        return out


def _least_count(words: DataFrame) -> float:
    """The lowest count (a power of 2 ** 0.25) that at most FREQUENT words reach. A count of counts, no sort."""
    step = F.floor(F.log2("n") * 4).cast("int")
    reach, cut = 0, float("inf")
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():  # at most 4 * 64 rows
        reach += r.k
        if reach > FREQUENT:
            break
        cut = 2.0 ** (r.s / 4) * (1 - 1e-9)
    return cut


def scored(docs: DataFrame, parts: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row.

    Learns from the rows whose fold is not ``held_out``. Null texts are empty: their one token is the end. Without
    training rows all counts are 0 and the model is nearly uniform. Repeated rows count, and are scored, as often as they come; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold("doc_id", parts) == held_out).alias("held_out"))
    train = rows.where("not held_out")
    sums = pin(train.select("text").mapInArrow(_counted, "what int, key bigint, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n")), "grams")
    n_train = train.count()
    word_sums = sums.where("what = 1").select("key", "n")
    total, distinct = word_sums.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (total or 0) + n_train, distinct + (n_train > 0)

    gram_sums = sums.where("what = 0").select("key", "n")
    bit_sums = (gram_sums.mapInArrow(_bit_counts, "slot int, zeros bigint, ones bigint").groupBy("slot")
                .agg(*[F.least(F.sum(c), F.lit((1 << 31) - 1)).cast("int").alias(c) for c in ("zeros", "ones")]).toArrow())
    counts = np.zeros((sum(SLOTS), 2), np.int32)
    at = bit_sums["slot"].to_numpy()
    counts[at, 0], counts[at, 1] = bit_sums["zeros"].to_numpy(), bit_sums["ones"].to_numpy()
    del bit_sums, at
    told = spark.sparkContext.broadcast(_Counts(counts))  # SLOTS * 8 bytes in a worker
    model = Model(counts[:, 0], counts[:, 1], totals=_totals(gram_sums, told))
    told.destroy()
    del counts
    top = word_sums.where(F.col("n") >= _least_count(word_sums)).toArrow()
    order = np.argsort(top["key"].to_numpy())
    common = (top["key"].to_numpy()[order], top["n"].to_numpy()[order])
    shared = spark.sparkContext.broadcast((model, common))  # SLOTS * 4 bytes and FREQUENT * 16

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (keys, counts) = shared.value
        costs = _Costs.of(model)
        logs = np.log10(counts + 0.5)
        for batch in batches:
            for lo, hi, data, ends in blocks(batch.column("text")):
                n_docs, size = hi - lo, np.diff(ends) + 1
                bits = np.bincount(np.repeat(np.arange(n_docs), size), costs(grams(data, ends)), n_docs)
                hashes, at = word_hashes(data, ends)
                n = np.diff(at)
                doc = np.repeat(np.arange(n_docs), n)
                hashes = hashes.view(np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    known = keys[place] == hashes
                else:
                    place, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                found = np.bincount(doc[known], minlength=n_docs)
                part = np.bincount(doc[known], logs[place[known]] if len(keys) else None, n_docs)
                rare_doc, rare = doc[~known], hashes[~known]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                first = np.ones(len(rare), bool)
                first[1:] = (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])
                first = np.flatnonzero(first)
                starts = pa.array(np.searchsorted(rare_doc[first], np.arange(n_docs + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("uid").slice(lo, n_docs), batch.column("doc_id").slice(lo, n_docs), batch.column("held_out").slice(lo, n_docs),
                    pa.array(n + 1), pa.array(found), pa.array(part.astype(np.float64)), pa.array(bits), pa.array(size),
                    pa.ListArray.from_arrays(starts, pa.array(rare[first])),
                    pa.ListArray.from_arrays(starts, pa.array(np.diff(np.append(first, len(rare))).astype(np.int32)))],
                    ["uid", "doc_id", "held_out", "n_tokens", "found", "part", "bits", "size", "rare", "times"])

    kind = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, found bigint, part double, bits double, size bigint, rare array<bigint>, times array<int>"
    texts = pin(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, kind), "scores")
    rest = texts.where("size(rare) > 0").select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    counted = rest.join(word_sums, "key", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"))
    end = float(np.log10(n_train + 0.5))
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    return texts.join(counted, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("found") + F.coalesce("also", F.lit(0)) + F.lit(int(n_train > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), (F.col("bits") / F.col("size")).alias("bits_per_byte"))
