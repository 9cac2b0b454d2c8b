from __future__ import annotations

import os
import sys
import uuid

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session("tests", cores="8", **{
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SMALL


@pytest.fixture
def ts():
    from pyspark.sql import functions as F

    return lambda text="2024-06-01 12:00:00": F.to_timestamp_ntz(F.lit(text))


@pytest.fixture
def scratch(tmp_path):
    return lambda label="t": str(tmp_path / f"{label}-{uuid.uuid4().hex}")


@pytest.fixture
def no_broadcast(spark):
    """Make every join behave as if its sides were too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def store(spark, scratch):
    from stores import Store, site_tables

    return Store(spark, site_tables(), scratch)
