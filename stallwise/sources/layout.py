"""Facts laid out by key, so that joins on the key move nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.sources.tables import Tables


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Write the rows as a table in buckets of the key, sorted by it; return the table.

    Rows are dealt to tasks by bucket first, so each task writes one file, not one
    for each bucket.  Tables with the same number of buckets join on the key, and
    aggregate by it, without a shuffle; a frequent key stays in one bucket, which a
    later join can't split, so this is for keys of few rows, like those of orders.
    """
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


class LaidOut(Tables):
    """The tables of a folder, with orders and their lines from a database where both are in buckets of the order."""

    KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}

    def __init__(self, plain: Tables, database: str, buckets: int):
        super().__init__(plain.spark, plain.folder)
        self._database = database
        for name, key in self.KEYS.items():
            write_bucketed(getattr(plain, name), f"{database}.{name}", key, buckets)

    def __getattr__(self, name: str) -> DataFrame:
        if name in LaidOut.KEYS:
            return self.spark.table(f"{self._database}.{name}").select("*")
        return super().__getattr__(name)


def files_per_bucket(df: DataFrame) -> int:
    """The most files that a bucket of a table has."""
    name = F.regexp_extract(F.input_file_name(), "_([0-9]+)[.]c000", 1)
    files = df.select(F.input_file_name().alias("file"), name.alias("bucket")).distinct()
    return files.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
