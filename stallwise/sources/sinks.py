"""Reporting tables whose content changes in one step.

Rows are written to a new folder that nobody reads, and the table is a view on the
folders that count.  Replacing the view is one change of the catalog: a reader gets
the old rows or the new ones, a write that fails leaves everything as it was, and
one that is repeated gives the same table.

A table partitioned by day is a view on several folders, each for a range of days,
all ranges apart.  The layout is kept as a property of the view, so it changes with
it.  A refresh of some days adds a folder and takes the days from the others; their
files stay until ``forget_versions``.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a daily table; beyond, all but the first are written together.
MOST_FOLDERS = 64

LAYOUT, COLUMNS, DAY = "stallwise.layout", "stallwise.columns", "stallwise.day"


def _home(spark: SparkSession, table: str) -> str:
    """The folder of a table's versions, under the location of its database."""
    database, _, name = table.rpartition(".")
    location = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{location.rstrip('/')}/{name}_versions"


def _new_version(spark: SparkSession, table: str) -> str:
    return f"{_home(spark, table)}/{uuid.uuid4().hex}"


def _point(spark: SparkSession, table: str, query: str, **properties: str) -> None:
    """Make the table the result of a query over files: the one step in which its content changes."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kept = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in properties.items())
    spark.sql(f"CREATE OR REPLACE VIEW {table}" + (f" TBLPROPERTIES ({kept})" if kept else "") + f" AS {query}")


def replace_table(df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the whole result as the new content of ``table``; return the table."""
    spark, folder = df.sparkSession, _new_version(df.sparkSession, table)
    df.write.partitionBy(*(partition_by or [])).parquet(folder)
    columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in df.schema.fields)
    _point(spark, table, f"SELECT {columns} FROM parquet.`{folder}`")
    return spark.table(table)


def _property(spark: SparkSession, table: str, name: str) -> str:
    return spark.sql(f"SHOW TBLPROPERTIES {table} ('{name}')").first()["value"]


def _point_days(spark: SparkSession, table: str, columns: str, day: str, layout: list[dict]) -> None:
    """A daily table of these folders: each with its path, first and last day, None for no bound."""
    names = [f"`{field.strip().split()[0]}`" for field in columns.split(",")]
    listed = ", ".join([*names, f"CAST(`{day}` AS DATE) AS `{day}`"])
    parts = []
    for entry in layout:
        first, last = (f"DATE'{entry[k]}'" if entry[k] else None for k in ("first", "last"))
        tests = [f"`{day}` >= {first}"] * bool(first) + [f"`{day}` <= {last}"] * bool(last)
        where = " AND ".join(tests) or "TRUE"
        if not first and last:  # the rows without a day stay with the oldest days
            where = f"({where} OR `{day}` IS NULL)"
        parts.append(f"SELECT {listed} FROM parquet.`{entry['path']}` WHERE {where}")
    if not parts:
        nulls = ", ".join(f"CAST(NULL AS {field.strip().split(None, 1)[1]}) AS `{field.strip().split()[0]}`" for field in columns.split(","))
        parts = [f"SELECT {nulls}, CAST(NULL AS DATE) AS `{day}` WHERE FALSE"]
    _point(spark, table, " UNION ALL ".join(parts), **{LAYOUT: json.dumps(layout), COLUMNS: columns, DAY: day})


def create_daily_table(spark: SparkSession, table: str, columns: str, day: str) -> None:
    """An empty table of simple columns (``name TYPE, ..``) and a day, unless there is one."""
    if not spark.catalog.tableExists(table):
        _point_days(spark, table, columns, day, [])


def _write_days(df: DataFrame, table: str, columns: str, day: str) -> str | None:
    """The rows as a folder with one subfolder per day; None if there are no rows."""
    spark, folder = df.sparkSession, _new_version(df.sparkSession, table)
    fields = [field.strip().split(None, 1) for field in columns.split(",")]
    rows = df.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields], F.col(day).cast("date").alias(day))
    rows.write.partitionBy(day).parquet(folder)
    path, files = _path(spark, folder)
    return folder if any(f.isDirectory() for f in files.listStatus(path)) else None


def load_days(df: DataFrame, table: str, day: str) -> None:
    """First load: all the days of ``df`` in place of what the table holds."""
    spark = df.sparkSession
    columns = _property(spark, table, COLUMNS)
    folder = _write_days(df, table, columns, day)
    _point_days(spark, table, columns, day, [{"path": folder, "first": None, "last": None}] if folder else [])


def refresh_days(df: DataFrame, table: str, day: str, first: dt.date, last: dt.date) -> None:
    """Replace the days [first, last]; a day that has no rows any more disappears, other days are not touched."""
    spark = df.sparkSession
    columns, layout = _property(spark, table, COLUMNS), json.loads(_property(spark, table, LAYOUT))
    folder = _write_days(df.filter(F.col(day).between(first, last)), table, columns, day)
    layout = [piece for entry in layout for piece in _without(entry, first, last)]
    if folder:
        layout.append({"path": folder, "first": str(first), "last": str(last)})
    if len(layout) > MOST_FOLDERS:
        layout = _gathered(spark, table, columns, day, layout)
    _point_days(spark, table, columns, day, layout)


def _without(entry: dict, first: dt.date, last: dt.date) -> list[dict]:
    """What is left of a folder's days without [first, last], as up to two ranges."""
    one = dt.timedelta(days=1)
    parts = [{**entry, "last": min(entry["last"] or str(dt.date.max), str(first - one))}, {**entry, "first": max(entry["first"] or "", str(last + one))}]
    return [p for p in parts if not (p["first"] and p["last"]) or p["first"] <= p["last"]]


def _gathered(spark: SparkSession, table: str, columns: str, day: str, layout: list[dict]) -> list[dict]:
    """The same days with all folders but the one of the oldest days written as one."""
    oldest, *others = sorted(layout, key=lambda e: e["first"] or "")
    rows = None
    for entry in others:
        part = spark.read.parquet(entry["path"]).filter(F.col(day) >= F.lit(entry["first"]).cast("date"))
        part = part.filter(F.col(day) <= F.lit(entry["last"]).cast("date")) if entry["last"] else part
        rows = part if rows is None else rows.unionByName(part)
    folder = _write_days(rows, table, columns, day)
    ends = [e["last"] for e in others]
    whole = {"path": folder, "first": others[0]["first"], "last": None if None in ends else max(ends)}
    return [oldest, whole] if folder else [oldest]


def _path(spark: SparkSession, folder: str):
    """A folder as Hadoop's file system sees it, and that file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def forget_versions(spark: SparkSession, table: str) -> int:
    """Delete the folders that the table doesn't read any more; return how many.

    Readers that began before the last change may still need them, so this is for
    times when none is left.
    """
    path, files = _path(spark, _home(spark, table))
    used = {part for name in spark.table(table).inputFiles() for part in name.split("/")}
    old = [f.getPath() for f in files.listStatus(path) if f.getPath().getName() not in used]
    for folder in old:
        files.delete(folder, True)
    return len(old)
