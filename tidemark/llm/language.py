"""Language identification: the language family first, then one-versus-one machines within the family.

Features are hashed byte bigrams and trigrams of the lower-cased letters. Linear support vector machines with
squared hinge loss are fitted on a bounded sample of distinct labelled texts (SAMPLE in all, in equal shares
for the languages): one machine per family against the other families, and one per pair of languages of a
family. A text gets the family of largest margin, then the language that wins most duels in it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import fold, text_sample
from tidemark.llm.textblocks import blocks, gram_counts, lean, lowered, unit

SAMPLE = 6000  # texts to fit on
BUCKETS = 1024  # of each n-gram size
SHARPNESS = 4.0  # of the logistic that turns a margin into a score
BLOCK = 512  # documents

#: Families by ISO code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is lb fy",
    "romance": "fr es it pt ca gl ro oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    letters = _LETTERS[lowered(data)]
    return np.hstack([unit(np.log1p(gram_counts(letters, ends, n, BUCKETS))) for n in (2, 3)]) * np.float32(0.7071)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, ends in blocks(batch.column("text"), docs=BLOCK):
            x = features(data, ends).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def machine(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; both signs weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = sign.astype(np.float32)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step, t = np.float32(1 / (4 + ridge)), 1.0
    for _ in range(rounds):  # accelerated gradient
        lack = np.maximum(0, 1 - sign * (x @ ahead))
        after = ahead - step * (np.float32(ridge) * ahead - 2 * ((weight * lack * sign) @ x))
        t_after = float((1 + np.sqrt(1 + 4 * t * t)) / 2)
        w, ahead, t = after, after + np.float32((t - 1) / t_after) * (after - w), t_after
    return w


class Model:
    """Machines over families and over the pairs of languages in each."""

    def __init__(self, lang: np.ndarray, x: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        family = np.array([_FAMILY.get(v, v) for v in lang], object)
        self.families = sorted(set(family.tolist()))
        self.members = [[v for v in self.langs if _FAMILY.get(v, v) == f] for f in self.families]
        zero = np.zeros((0, x.shape[1] + 1), np.float32)
        self.family_w = np.vstack([zero, *(machine(x, np.where(family == f, 1.0, -1.0)) for f in self.families if len(self.families) > 1)])
        self.duels = []
        for members in self.members:
            for a, b in itertools.combinations(members, 2):
                two = (lang == a) | (lang == b)
                self.duels.append((a, b, machine(x[two], np.where(lang[two] == a, 1.0, -1.0))))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        place = {v: i for i, v in enumerate(self.langs)}
        sure = np.full(len(x), np.inf)
        family = np.zeros(len(x), np.int64)
        if len(self.families) > 1:
            margin = x @ self.family_w.T
            family, sure = margin.argmax(axis=1), np.minimum(sure, margin.max(axis=1))
        allowed = np.array([[v in m for v in self.langs] for m in self.members])[family]
        wins, total, least = (np.zeros((len(x), len(self.langs))) for _ in range(3))
        least += np.inf
        for a, b, w in self.duels:
            m = x @ w
            for v, s in ((place[a], m), (place[b], -m)):
                wins[:, v] += s > 0
                total[:, v] += s
                least[:, v] = np.minimum(least[:, v], s)
        rank = np.where(allowed, wins + 0.5 + 0.4 * np.tanh(total), -1)
        best = rank.argmax(axis=1)
        sure = np.minimum(sure, least[np.arange(len(x)), best])
        score = np.where(np.isinf(sure), 1.0, 1 / (1 + np.exp(-SHARPNESS * np.where(np.isinf(sure), 0, sure))))
        return np.array(self.langs, object)[best], score


def fit(rows: DataFrame) -> Model | None:
    """A model of (text, lang); rows without a letter or a language teach nothing. None without any such row."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    got = text_sample(known, "lang", SAMPLE).mapInArrow(_vectors, "lang string, x binary").toArrow()
    if got.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, -1)
    return Model(np.array(got["lang"].to_pylist(), object), x)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Rows are
    independent: repeated rows get equal results, other columns are not read.
    """
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs) x 2049 floats

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, ends in blocks(batch.column("text"), docs=BLOCK):
                lang, score = shared.value.predict(features(data, ends))
                lettered = batch.column("lettered").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo),
                    pa.array(np.where(lettered, lang, "und"), pa.string()), pa.array(np.where(lettered, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """``identify`` with a model of the rows that are not held out."""
    return identify(docs, fit(docs.where(fold("doc_id", 5) != 0)))
