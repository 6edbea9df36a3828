"""Tables in the shared folder, which cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, which only a session in one process
    may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get()
    return found.rstrip("/")


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """The path, whose files go with the session at the latest."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that neither a lost executor nor a long loop recomputes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    path = getattr(df, "_settled", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
