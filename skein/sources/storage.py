"""Intermediate tables on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests), a folder of this machine."""
    set_by_cluster = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share: a folder of this machine would lose tables on {master}")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-shared-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files outlive any executor; the file system drops them when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        if "/skein-" in file:
            folder = jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
