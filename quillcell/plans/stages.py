"""A store of finished stages: a re-run with the same options reads them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillcell.session import file_system, qualified


def write_text(path: str, text: str) -> None:
    """A small file, written through the file system that Spark would use for the path."""
    system, where = file_system(path)
    system.mkdirs(where.getParent())
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(path: str) -> str:
    row = SparkSession.active().read.text(qualified(path), wholetext=True).first()
    return row[0] if row else ""


def exists(path: str) -> bool:
    system, where = file_system(path)
    return system.exists(where)


def input_mark(path: str | None) -> str:
    """Name, length and time of change of an input, so that a changed file makes a stage stale."""
    if not path or not exists(path):
        return str(path)
    system, where = file_system(path)
    status = system.getFileStatus(where)
    return f"{qualified(path)}:{status.getLen()}:{status.getModificationTime()}"


class StageStore:
    """Parquet tables under ``root/stages``, keyed by name and option digest.

    A stage counts as finished when Spark's success marker is there, so a run that died
    while writing starts that stage again.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: str = ""):
        """``inputs`` stands for the state of the input files, see :func:`input_mark`."""
        self.inputs = inputs
        self.spark, self.root = spark, qualified(root.rstrip("/"))

    def path(self, name: str, digest: str) -> str:
        return f"{self.root}/stages/{name}-{digest}{self.inputs}"

    def get(self, name: str, digest: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(name, digest)
        if not exists(f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
