"""Session helpers: reading tables, shared tables that cut lineage, and streams of groups."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read again: lineage ends here and a lost executor
    costs no recomputation. dropped() removes it; what is left goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored() table that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go now; else they fill the disk until the driver happens to collect its
    garbage. To be called where a stored() table has replaced a large shuffle."""
    spark._jvm.System.gc()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast and renamed: name='type' or name='column:type'."""
    picked = []
    for name, spec in columns.items():
        source, _, kind = spec.rpartition(":")
        picked.append(F.col(f"`{source or name}`").cast(kind).alias(name))
    return df.select(*picked)


def runs(batches, key: str):
    """Tables of equal key from batches sorted by key; each table is one whole group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                if held and keys[lo] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = keys[lo]
                held.append(batch.slice(lo, i - lo))
                lo = i
    if held:
        yield last, pa.Table.from_batches(held)
