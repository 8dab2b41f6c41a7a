"""Small mapping sheets kept as text files."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stallwise.session import shared_folder

#: Sheets that come with the package.
SHEETS = Path(__file__).resolve().parent.parent / "sheets"


def mapping_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV sheet with a header line and declared columns, in the order of the header.

    Nothing is inferred; a line or a header that does not fit the schema fails the
    read.  Spark broadcasts the sheet if the file is small, by its size on disk.
    """
    options = {
        "header": "true", "enforceSchema": "false", "mode": "FAILFAST",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    }
    return spark.read.schema(schema).options(**options).csv(path)


def packaged_sheet(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A sheet of the package, read from the shared folder.

    Executors do not see the package's files, so the lines are written there first,
    under a name that changes with them: a sheet is written once.
    """
    lines = (SHEETS / f"{name}.csv").read_text(encoding="utf-8").splitlines()
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/sheets/{name}-{digest}"
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("ignore").text(path)
    return mapping_sheet(spark, path, schema)
