"""Intermediate tables in the folder that driver and executors share.

They lie in ``spark.checkpoint.dir``, one folder an application. The folder is removed when the application's JVM ends, or
sooner by ``clear``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "spark.arborist.local.dir"


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, or in the folder given to ``SparkContext.setCheckpointDir``.

    Where neither is set a new local folder serves with a local master, as in tests; a cluster gets an error, since its executors
    would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    given = spark._jsc.sc().getCheckpointDir()
    if not folder and given.isDefined():
        folder = given.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get(_LOCAL, None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.conf.set(_LOCAL, folder)
    own = f"{folder.rstrip('/')}/arborist-{spark.sparkContext.applicationId}"
    known = spark.conf.get("spark.arborist.dir", None)
    if known != own:
        _remove_at_exit(spark, own)
        spark.conf.set("spark.arborist.dir", own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends at files that every executor sees, so nothing is lost with an executor, and
    the reader knows the table's size when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that were not written yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
