"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed n-grams of its bytes, hashed n-grams of its byte classes (letter case, digits, each
symbol) and counts of repetition. Term weights (log counts, inverse document frequency) are projected on the
leading singular vectors of a bounded labelled sample. The sample's vectors and labels are broadcast; every
document is compared with all of them by exact cosine, one matrix product per block of documents, and the
nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import fold
from tidemark.llm.textblocks import blocks, gram_counts, lean, lowered, shingles, unit, words

SAMPLE = 4096  # labelled texts at most; 64 floats each are broadcast
BUCKETS = 1024  # of each kind of n-gram
TOPICS = 64
NEIGHBOURS = 32
POWER = 6  # of the cosine in a vote
ACCEPT = 0.7
BLOCK = 256  # documents

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0x61, 0x41, 0x30, 0x61


def terms(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Documents x (2 * BUCKETS + 4) log counts; each kind at unit length."""
    hashes, at = words(data, ends)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    again = []
    for back in (1, 2):
        same = np.zeros(len(hashes), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
        again.append(np.bincount(doc[same], minlength=len(n)))
    runs, of = shingles(hashes, at, 5)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    repeat = np.zeros(len(runs), bool)
    repeat[1:] = (runs[1:] == runs[:-1]) & (of[1:] == of[:-1])
    share = np.stack([again[0], again[1], np.bincount(of[repeat], minlength=len(n))], axis=1) / np.maximum(n, 1)[:, None]
    repeats = np.hstack([(n > 0)[:, None].astype(np.float32), 3 * share.astype(np.float32)])
    return np.hstack([
        unit(np.log1p(gram_counts(lowered(data), ends, 3, BUCKETS))),
        unit(np.log1p(gram_counts(_CLASS[data], ends, 4, BUCKETS))),
        unit(repeats)]).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text"), docs=BLOCK):
            x = terms(data, ends).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


class Model:
    """Projection, and the projected sample with its labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        n = len(x)
        self.weight = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        self.weight[2 * BUCKETS :] = 1.0
        x = self.weighted(x)
        _, vectors = np.linalg.eigh(x.T @ x)
        self.topics = np.ascontiguousarray(vectors[:, ::-1][:, :TOPICS], np.float32)
        self.near = unit(x @ self.topics).astype(np.float32)
        self.label = label.astype(np.float32)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.weight
        for kind in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
            x[:, kind] = unit(x[:, kind])
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the neighbours' similarity that has label 1; 0 for a text without terms."""
        cosine = unit(self.weighted(x) @ self.topics) @ self.near.T
        k = min(NEIGHBOURS, cosine.shape[1])
        top = np.argpartition(cosine, -k, axis=1)[:, -k:]
        vote = np.maximum(np.take_along_axis(cosine, top, axis=1), 0).astype(np.float64) ** POWER
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.label[top]).sum(axis=1) / np.where(total > 0, total, 1), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled documents outside the held-out fold; None if there is none.

    The sample is the SAMPLE ids of lowest hash, equal texts counted once. An id with both labels teaches nothing.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold("doc_id", 4) != 2)
             .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
             .select("doc_id", F.col("label").cast("int").alias("label")))
    share = min(1.0, 1.3 * (SAMPLE + 50) / max(1, known.count()))  # so that a few ids more than needed are sorted
    cut = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    known = known.where(F.xxhash64("doc_id") <= cut).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(known), "doc_id")  # at most SAMPLE ids
             .groupBy("label", F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"))
             .orderBy("h").limit(SAMPLE))
    got = texts.select("label", "text").repartition(16, "text").mapInArrow(_vectors, "label int, x binary").toArrow()
    if got.num_rows == 0:
        return None
    order = np.argsort(np.array(got["x"].to_pylist(), object), kind="stable")  # rows arrive in any order
    x = np.stack([np.frombuffer(got["x"][int(i)].as_py(), np.float16) for i in order]).astype(np.float32)
    return Model(x, got["label"].to_numpy()[order])


def scores(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; with ``keep`` the accepted rows, unchanged.

    A text without bytes, and any text where nothing was learned, scores 0 (with ``keep`` and no model all rows
    stay). Labels, language, source and id are not inputs. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    if model is None:
        if keep:
            return docs
        return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def rated(column: pa.Array) -> np.ndarray:
        out = [shared.value.score(terms(data, ends)) for _, _, data, ends in blocks(column, docs=BLOCK)]
        return np.concatenate(out) if out else np.zeros(0)

    @lean
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(rated(batch.column("text")) >= ACCEPT))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = rated(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    if keep:
        return docs.mapInArrow(select, docs.schema)
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
