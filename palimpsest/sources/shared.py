"""Intermediate tables in the folder that the driver and all executors share."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Only a local master may do without the setting: a folder under the local
    temporary directory takes its place.  On a cluster that would be another folder
    on every machine, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "palimpsest-shared")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends at files that outlive executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """``df``, after a collection in the driver by which Spark drops the shuffle files of finished steps."""
    df.sparkSession._jvm.System.gc()
    return df


def removed(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` gave and that no later step reads."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(hadoop).delete(at, True)
