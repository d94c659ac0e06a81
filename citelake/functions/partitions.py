"""Where tables are staged, and over how many tasks a scan is spread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a run on one machine (tests) gets a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="citelake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores, dealt over all of them before costly work on its rows."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage and plans, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/citelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete the table behind a staged frame, once nothing reads it any more."""
    spark = staged.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
