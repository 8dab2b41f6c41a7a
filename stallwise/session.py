"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for.  They are defaults for a new session; a
# session handed in by the caller keeps whatever its owner chose.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a frequent key even if the plan then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "stallwise", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` overrides or adds settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Switch the skew handling on in a session made elsewhere."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql.adaptive."):
            spark.conf.set(key, value)


#: Folders of local applications without the setting.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: there driver and
    executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="stallwise-")
    return _local_folders[application]


def steps_folder(spark: SparkSession) -> str:
    """Where the steps of this application are written."""
    return f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: the lineage ends there.

    Written in columns, so what reads it reads only what it needs.
    """
    path = f"{steps_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_steps(spark: SparkSession) -> bool:
    """Delete the steps of this application, when nothing reads its results any more; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_database(spark: SparkSession) -> str:
    """Create an empty database stored under the shared folder; return its name."""
    name = f"stallwise_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}/{name}'")
    return name
