"""Tables in the shared folder: what cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster, whose executors
    couldn't read it, this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("palimpsest.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: later reads survive lost executors and don't recompute."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes all tables that this application has written so; results that are read from them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
