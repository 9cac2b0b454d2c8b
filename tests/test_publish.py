"""Rows and log of a batch show together or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.session import publish, published


def test_a_writer_lost_in_between_leaves_the_last_publication(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert published(spark, folder) is None
    rows, log = spark.range(10).toDF("k"), spark.range(3).toDF("version")
    first = publish(folder, {"rows": rows, "log": log})
    assert published(spark, folder) == (1, first)

    broken = log.select(F.raise_error(F.lit("lost")).cast("bigint").alias("version"))
    with pytest.raises(Exception, match="lost"):
        publish(folder, {"rows": rows.union(rows), "log": broken})
    assert published(spark, folder) == (1, first)
    assert spark.read.parquet(f"{first}/rows").count() == 10

    # a batch that reads what it replaces: the old folder stays until the new one is named
    before = spark.read.parquet(f"{first}/rows")
    second = publish(folder, {"rows": before.union(rows), "log": log})
    assert published(spark, folder) == (2, second) and spark.read.parquet(f"{second}/rows").count() == 20
    assert before.count() == 10


def test_nothing_is_refused(tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        publish(str(tmp_path / "store"), {})
