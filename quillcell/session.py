"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillcell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is left to ``spark-submit`` when it is not given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; only a local master may get a scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quillcell-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written table.

    A lost executor then costs a re-read and not a replay of all earlier rounds. Unlike an
    RDD checkpoint the table is computed once, is read by column, and has a known size, so
    joins with it can be planned from that size.
    """
    return written(df, "cut")[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and the path at which to ``discard`` it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads, through Hadoop's own file system."""
    if not os.path.basename(path) or not path.startswith(checkpoint_dir(spark)):
        raise ValueError(f"{path} is not below the checkpoint folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables a plan writes and reads back."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def file_system(path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system and path object, as Spark itself would resolve ``path``."""
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(path: str) -> str:
    """``path`` with scheme and full folder, so that all parts of a run mean the same place."""
    system, where = file_system(path)
    return system.makeQualified(where).toString()
