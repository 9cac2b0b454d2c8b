"""Reading tables and logs, and appending to logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.rows import live
from tidemark.schema import Table


def scan(spark: SparkSession, path: str, declared: Table | StructType) -> DataFrame:
    """A declared table from Parquet: no schema inference, and only declared columns are read."""
    schema = declared.schema if isinstance(declared, Table) else declared
    return spark.read.schema(schema).parquet(path)


def snapshot(rows: DataFrame, table: Table, include_deleted: bool = False, ordered: bool = False) -> DataFrame:
    """Current rows in declared column order; range-partitioned by key if ``ordered``."""
    kept = rows if include_deleted else live(rows, table.soft_delete)
    kept = kept.select(table.columns)
    return kept.orderBy(table.pk) if ordered else kept


def append_log(entries: DataFrame, path: str) -> None:
    """Append to a log partitioned by entity. Rows are sorted by version inside each file, so
    a cursor read skips whole row groups."""
    (entries.sortWithinPartitions("entity", "version")
     .write.mode("append").partitionBy("entity").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "pk_value string, op string, version bigint, changed_at timestamp_ntz, entity string").parquet(path)


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
