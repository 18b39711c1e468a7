"""Session helpers: a tuned local session and a safe checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


WRITTEN = "written-"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seriesloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Point Spark at the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    folder of one machine would lose the data with that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seriesloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a large frame as a table beside the checkpoints and read on from there.

    Columnar files are smaller and faster than a checkpoint of rows, later steps read only
    the columns they need, and Spark knows the size. :func:`clear_written` removes them.
    """
    path = f"{use_checkpoint_dir(df.sparkSession)}/{WRITTEN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_facts(df: DataFrame) -> DataFrame:
    """Checkpoint a small frame, one row per series or slice, that several steps read."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_written(spark: SparkSession) -> None:
    """Delete the tables and checkpoints that this application wrote; frames that read them end."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for pattern in (f"{WRITTEN}*", "tables-*", "rdd-*"):
            for entry in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
                files.delete(entry.getPath(), True)
