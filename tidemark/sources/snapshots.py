"""The last raw state of each dataset, as versions and a pointer to one of them.

A snapshot is a folder of Parquet versions and a file ``CURRENT`` that names the
valid one. Saving writes a whole new version, then replaces the pointer by one
rename, then deletes versions that neither the new nor the last pointer named:
whatever step fails, the pointer names a whole version, and a plan that still
reads the last one can go on."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
VERSION = re.compile(r"v-[0-9a-f]{32}")


def snapshot_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_.-]', '_', dataset)}.parquet"


class _Folder:
    """Files of one snapshot, in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.at(path)
        self.fs = self.path.getFileSystem(self.conf)

    def at(self, *names):
        return self.jvm.org.apache.hadoop.fs.Path(*names)

    def read(self, name: str) -> str | None:
        file = self.at(self.path, name)
        if not self.fs.exists(file):
            return None
        stream = self.fs.open(file)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside and rename it over the old one, in one step."""
        beside = self.at(self.path, f"_{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf)
        context.rename(context.makeQualified(beside), context.makeQualified(self.at(self.path, name)), over)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path)]

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(self.path, name), True)


def current_version(spark: SparkSession, root: str, dataset: str) -> str | None:
    """Path of the version that is valid now."""
    path = snapshot_path(root, dataset)
    try:
        name = _Folder(spark, path).read(POINTER)
    except Py4JJavaError:  # the store can't be read
        return None
    return f"{path}/{name}" if name and VERSION.fullmatch(name) else None


def load_snapshot(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """None where there is no snapshot or it can't be read."""
    path = current_version(spark, root, dataset)
    try:
        return spark.read.parquet(path) if path else None
    except AnalysisException:
        return None


def _write_version(df: DataFrame, path: str) -> str:
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def _clean(folder: _Folder, kept: set[str | None]) -> None:
    for name in folder.names():
        if (VERSION.fullmatch(name) and name not in kept) or name.startswith(f"_{POINTER}-"):
            folder.delete(name)


def save_snapshot(df: DataFrame, root: str, dataset: str) -> str:
    """Save ``df`` as the valid version; its path. The last version stays until
    the next save."""
    path = snapshot_path(root, dataset)
    name = _write_version(df, path)
    folder = _Folder(df.sparkSession, path)
    before = folder.read(POINTER)
    folder.replace(POINTER, name)
    _clean(folder, {name, before})
    return f"{path}/{name}"
