"""Session helpers: Spark settings for local work and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "filmgrain", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix=f"filmgrain-{os.getpid()}-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def ship(spark: SparkSession, name: str, content: bytes) -> None:
    """Gives the executors' Python workers a zipped package, through the shared folder."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addPyFile(path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
