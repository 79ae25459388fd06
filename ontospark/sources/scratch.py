"""Intermediates written into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediates, under ``spark.checkpoint.dir``; it is removed when the application ends.

    Where the setting is unset, one temporary folder serves local runs; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="ontospark-")
        _own[app] = f"{folder.rstrip('/')}/ontospark-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return _own[app]


def written(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    It cuts the lineage with a table that outlives any executor, and fixes what
    ``spark_partition_id`` or ``monotonically_increasing_id`` gave.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, few: int) -> DataFrame:
    """``df`` as a side of a join: broadcast up to ``few`` rows, merged beyond.

    Without a hint the sizes of compressed files would decide, which say little about rows in memory.
    """
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df.hint("merge")
