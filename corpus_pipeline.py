"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the
documents of the next. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dup, packing, pii, quality
from tidemark.llm.tokenizers_path import definition
from tidemark.session import scratch_path, use_scratch


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    return quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with the sources' mixture in each."""
    return packing.pack(docs, definition("word_bpe_49k.json"))


def _ready(stage):
    """The stage in a session that has a scratch folder: the one it names, or one of its own for a local session."""
    return lambda spark, docs, sf_dir: stage(use_scratch(spark), docs, sf_dir)


STAGES = [
    ("quality", _ready(accept_quality)),
    ("near_duplicates", _ready(drop_near_duplicates)),
    ("decontamination", _ready(drop_leaks)),
    ("personal_data", _ready(redact)),
    ("packing", _ready(pack)),
]

#: No SQL: classifier, signatures and tokenizer have no SQL form. tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = use_scratch(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
