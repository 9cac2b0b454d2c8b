"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cores: str = "8", **settings: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM never compiles methods above 8000 bytes; let Spark split such projections
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return use_scratch(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and every executor can reach")
    return f"{base.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def publish(folder: str, made: dict[str, DataFrame]) -> str:
    """Write several frames (the rows and the log of a batch) as one: all of them show, or none does.

    Each publication is a folder of its own under ``folder``; a one-row marker that names it is written after all
    of its frames, and readers see only what the newest marker names. A writer that is lost in between leaves the
    last publication as it was. One writer at a time, as for every log here. Returns the folder published.
    """
    if not made:
        raise ValueError("nothing to publish")
    spark = next(iter(made.values())).sparkSession
    turn = (published(spark, folder) or (0, None))[0] + 1
    path = f"{folder.rstrip('/')}/data/{turn:012d}-{uuid.uuid4().hex}"
    for name, df in made.items():
        df.write.parquet(f"{path}/{name}")
    row = spark.createDataFrame([(turn, path)], "turn bigint, path string").coalesce(1)
    row.write.mode("append").parquet(f"{folder.rstrip('/')}/markers")
    return path


def published(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(turn, path) of the newest complete publication; None before the first."""
    markers = f"{folder.rstrip('/')}/markers"
    place = spark._jvm.org.apache.hadoop.fs.Path(markers)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    newest = spark.read.schema("turn bigint, path string").parquet(markers).orderBy("turn", ascending=False).first()
    return (newest.turn, newest.path) if newest else None


def use_scratch(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Names the scratch folder where the session has none: ``folder``, or, for a session within this
    process only, a new folder of this machine. On a cluster the folder must be a shared one. Python workers
    started from now on find this package where it lies (elsewhere it is shipped with ``--py-files``)."""
    root, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    if not spark.conf.get("spark.checkpoint.dir", None):
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None
        if not folder and not alone:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and every executor can reach")
        spark.conf.set("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="tidemark-"))
    return spark


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation, and
    makes anything that depends on partition layout a stored fact.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.pinned_at = path
    return stored


def unpin(*frames: DataFrame | None) -> None:
    """Remove what ``pin`` stored, once nothing will read it again: the rounds of a loop that are behind it."""
    for df in frames:
        if df is not None and getattr(df, "pinned_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.pinned_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            df.pinned_at = None
