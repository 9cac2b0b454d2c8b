"""Dense global indexes, samples and pages without a one-task sort.

Every index here is a ``row_number()`` over the whole table (or over each group), found in
two levels: rank inside a bucket, plus the number of rows in the buckets before it. The
buckets follow the sort order, so the sum is the global rank, and no task ever sees more
than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import pin

_BUCKET, _SIZE, _START, _RANK = "_bucket", "_size", "_start", "_rank"


def _starts(tagged: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each bucket. One row per bucket, counted map-side."""
    sizes = tagged.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias(_SIZE))
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, _BUCKET, F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)).alias(_START))


def _two_level(df: DataFrame, by: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    tagged = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    return (
        tagged.withColumn(_RANK, F.row_number().over(inside))
        .join(_starts(tagged, by), [*by, _BUCKET])
        .withColumn(out, F.col(_START) + F.col(_RANK))
        .drop(_BUCKET, _START, _RANK)
    )


def index_by_integer(df: DataFrame, key: str, by=(), out: str = "idx", bits: int = 20) -> DataFrame:
    """1-based index in the order of an integer ``key``, unique inside each ``by`` group.

    A bucket spans ``2**bits`` key values and so holds at most that many rows, however
    many of the rows belong to one group. For sparse keys use ``index_unique``. A null key
    fails the job: it has no place in the order.
    """
    known = F.coalesce(F.col(key).cast("bigint"), F.raise_error(F.lit(f"{key} is null")).cast("bigint"))
    bucket = F.shiftright(known, bits)
    return _two_level(df, list(by), bucket, [key], out)


def index_by_digest(df: DataFrame, digest: str, by=(), out: str = "idx", digits: int = 3) -> DataFrame:
    """1-based index in the order of a hex ``digest`` of a unique key. The leading digits
    are uniform, so the ``16**digits`` buckets are even."""
    return _two_level(df, list(by), F.substring(F.col(digest), 1, digits), [digest], out)


def index_sorted(df: DataFrame, order: list[str], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """1-based index in any total order (text keys, several columns).

    Range-partitions and sorts once, stores each row's place, and adds the rows of the
    partitions before it. The place is written to the shared folder because range bounds
    are sampled anew by every job.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(_BUCKET, F.spark_partition_id())
        .withColumn(_RANK, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = pin(placed, "sorted")
    return (
        stored.join(F.broadcast(_starts(stored, [])), _BUCKET)  # one row per partition
        .withColumn(out, F.col(_START) + F.col(_RANK) + 1)
        .drop(_BUCKET, _START, _RANK)
    )


def index_unique(df: DataFrame, key: str, out: str = "idx", bits: int = 20) -> DataFrame:
    """1-based index in the order of a unique integer ``key``, dense or sparse.

    Dense keys go by value range. Where that would make more buckets than a thousandth of the rows (random 64-bit
    ids make one a row), one range sort places them; the result is the same.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    buckets = 0 if low is None else (high >> bits) - (low >> bits) + 1
    if buckets <= max(4096, n // 1000):
        return index_by_integer(df, key, out=out, bits=bits)
    return index_sorted(df, [key], out=out)


def chunked(indexed: DataFrame, size: int, idx: str = "idx", out: str = "chunk") -> DataFrame:
    """Zero-based chunk number of each indexed row."""
    return indexed.withColumn(out, F.floor((F.col(idx) - 1) / size).cast("bigint"))


def chunk_count(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size)).cast("bigint")


def sample_exact(df: DataFrame, pk: str, seed, k: int, out: str = "idx", digits: int = 3) -> DataFrame:
    """Exactly ``k`` rows (all of them if there are fewer), uniform and without replacement,
    numbered 1..k.

    The rows with the ``k`` smallest digests of (seed, key). Bucket sizes tell which
    leading digits can hold them, so only about ``k`` rows are shuffled and ranked.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("sample"), F.col(pk).cast("string")))
    tagged = df.withColumn("_digest", digest).withColumn(_BUCKET, F.substring("_digest", 1, digits))
    needed = F.broadcast(_starts(tagged, []).filter(F.col(_START) < k))  # 16**digits rows at most
    inside = Window.partitionBy(_BUCKET).orderBy("_digest")
    return (
        tagged.join(needed, _BUCKET)
        .withColumn(out, F.col(_START) + F.row_number().over(inside))
        .filter(F.col(out) <= k)
        .drop(_BUCKET, _START, "_digest")
    )


def split_sample(df: DataFrame, pk: str, seed, first: int, second: int, labels=("update", "delete"),
                 digits: int = 3) -> DataFrame:
    """Two disjoint samples of exactly ``first`` and ``second`` rows, labelled in ``action``."""
    chosen = sample_exact(df, pk, seed, first + second, digits=digits)
    return chosen.withColumn("action", F.when(F.col("idx") <= first, labels[0]).otherwise(labels[1]))


def digits_for(rows: int, per_bucket: int = 1 << 20) -> int:
    """Hex digits that keep a digest bucket near ``per_bucket`` rows (3 to 5)."""
    digits = 3
    while digits < 5 and rows > per_bucket * 16 ** digits:
        digits += 1
    return digits


def keep_first(df: DataFrame, key: str, row_id: str, out: str) -> DataFrame:
    """``out`` = ``key`` on the row with the lowest ``row_id`` of that key, NULL elsewhere.

    The winners are a map-side-combined minimum, joined back on the unique row id, so a
    key shared by a third of the table costs no more than any other.
    """
    winners = (
        df.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.min(row_id).alias("_winner")).select("_winner")
    )
    return (
        df.join(winners, F.col(row_id) == F.col("_winner"), "left")
        .withColumn(out, F.when(F.col("_winner").isNotNull(), F.col(key)))
        .drop("_winner")
    )
