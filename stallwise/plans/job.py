"""One run of a job: steps that several sections share are made once, results carry the run's time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.session import checkpointed
from stallwise.sources.sinks import replace_table


class Run:
    """A run at a given time; nothing looks at the clock, so it can be repeated."""

    def __init__(self, spark: SparkSession, run_at: dt.datetime):
        self.spark, self.run_at = spark, run_at
        self._steps: dict[str, DataFrame] = {}

    @property
    def as_of(self) -> dt.date:
        return self.run_at.date()

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step of this name: computed and written when it is first asked for, read from there afterwards."""
        if name not in self._steps:
            self._steps[name] = checkpointed(make())
        return self._steps[name]

    def stamped(self, df: DataFrame, column: str = "updated_at") -> DataFrame:
        """The rows with the time of the run."""
        return df.withColumn(column, F.lit(self.run_at).cast("timestamp_ntz"))

    def publish(self, df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
        """The stamped rows as the content of a reporting table, which changes in one step."""
        return replace_table(self.stamped(df), table, partition_by)
