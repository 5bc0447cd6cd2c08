"""Session helpers: builder, importability on the workers, and cut points in the lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "lectio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for. On a cluster, leave master to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it; on a cluster, ship it with --py-files as well."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A session on one machine that has none, as in tests, gets a folder of its own; on a cluster that would be one for each machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that materialise wrote, and that sweep hasn't deleted yet.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: it is computed once, and outlives the executors that made it. sweep deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """Where the list of written folders ends now, for a later sweep of what comes after."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes what materialise wrote since a mark, or since the start. Call it once the results that read it are written or no longer needed."""
    while len(_WRITTEN) > since:
        delete(spark, _WRITTEN.pop())
