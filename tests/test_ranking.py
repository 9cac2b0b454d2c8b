from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.operators.skew import hot_keys, join_unique


def test_integer_index_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.7 else f"s{rng.randrange(5)}", v) for v in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {(r.g, r.v): r.idx for r in ranking.index_by_integer(df, "v", by=["g"], bits=12).collect()}
    for g in {g for g, _ in rows}:
        ordered = sorted(v for h, v in rows if h == g)
        assert [got[g, v] for v in ordered] == list(range(1, len(ordered) + 1))


def test_negative_keys_keep_their_order(spark):
    df = spark.createDataFrame([(v,) for v in (-5000, -1, 0, 7, 5000)], "v bigint")
    got = ranking.index_by_integer(df, "v", bits=4).orderBy("v").collect()
    assert [r.idx for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_sorted_index_over_text(spark, partitions):
    words = sorted({f"{random.Random(i).random():.9f}" for i in range(700)})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r.w: r.idx for r in ranking.index_sorted(df, ["w"], partitions=partitions).collect()}
    assert [got[w] for w in words] == list(range(1, len(words) + 1))


def test_split_sample_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")

    def split(parts):
        return {r.k: (r.idx, r.action) for r in
                ranking.split_sample(df.repartition(parts), "k", 9, 120, 80).collect()}

    one = split(2)
    assert one == split(7)
    assert sorted(i for i, _ in one.values()) == list(range(1, 201))
    assert sum(a == "update" for _, a in one.values()) == 120
    assert ranking.split_sample(df, "k", 9, 900, 900).count() == 1000  # no more than there are
    assert split(2) != {r.k: (r.idx, r.action) for r in ranking.split_sample(df, "k", 10, 120, 80).collect()}


def test_first_holder_keeps_the_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "id bigint, k string")
    got = {r.id: r.kept for r in ranking.keep_first(df, "k", "id", "kept").collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, no_broadcast, how):
    """A third of the rows on one key, NULL keys, and keys without a partner."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 400}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id bigint, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{j}", j) for j in range(0, 400, 2)], "r string, v bigint")
    assert hot_keys(left, "k") == ["hot"]
    plain = left.join(right, F.col("k") == F.col("r"), how)
    mine = join_unique(left, right, "k", "r", how)
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_never_holds_null(spark, no_broadcast):
    left = spark.createDataFrame([(i, None if i % 2 else "x" if i % 4 else f"k{i}") for i in range(400)], "id int, k string")
    assert None not in hot_keys(left, "k")
    right = spark.createDataFrame([("x", 1)], "r string, v int")
    assert join_unique(left, right, "k", "r").count() == 400
