"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        shared = tempfile.mkdtemp(prefix="llm-")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: the lineage ends there.

    Nothing needs the shuffle files of the write after it, so Spark is told to
    drop them then; the session's setting is put back.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
