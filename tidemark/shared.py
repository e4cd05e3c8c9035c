"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master gets a local
    folder; any other one raises, as its executors have disks of their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def _write(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there."""
    return _write(df, name)[1]


@contextmanager
def scratch_tables() -> Iterator:
    """A function like ``written`` whose tables are deleted at the end."""
    made: list[tuple[str, SparkSession]] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path, frame = _write(df, name)
        made.append((path, df.sparkSession))
        return frame

    try:
        yield keep
    finally:
        for path, spark in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(taken: list[str], name: str) -> str:
    """A column name like ``name`` that none of these has, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
