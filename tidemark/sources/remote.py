"""A dataset service that gives CSV by id, behind a fetcher that tests can replace."""

from __future__ import annotations

import base64
import io
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import csv
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Seconds to wait for a key check, metadata, data.
TIMEOUTS = {"validate": 10, "metadata": 15, "data": 60}

Fetcher = Callable[[str, str, float], bytes]


def http_fetch(url: str, key: str, timeout: float) -> bytes:
    token = base64.b64encode(f"{key}:".encode()).decode()
    request = urllib.request.Request(url, headers={"Authorization": f"Basic {token}"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


class KeyStore:
    """An API key: the environment first, then a file."""

    def __init__(self, variable: str, path: str | Path):
        self.variable, self.path = variable, Path(path)

    def load_with_source(self) -> tuple[str | None, str | None]:
        if os.environ.get(self.variable):
            return os.environ[self.variable], "environment"
        if self.path.exists() and (key := self.path.read_text(encoding="utf-8").strip()):
            return key, "file"
        return None, None

    def load(self) -> str | None:
        return self.load_with_source()[0]

    def save(self, key: str) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(key.strip(), encoding="utf-8")

    def delete(self) -> None:
        self.path.unlink(missing_ok=True)


def _arrow_csv(body: bytes, types: pa.Schema | None = None) -> pa.Table:
    """Rows of a CSV text; with ``types``, its columns as these, by their names."""
    options = csv.ConvertOptions(strings_can_be_null=True)
    if types is not None:
        options.column_types = types
        options.include_columns, options.include_missing_columns = types.names, True
    return csv.read_csv(io.BytesIO(body), convert_options=options)


class _OneDataset(InputPartition):
    def __init__(self, dataset_id: str):
        super().__init__(dataset_id)
        self.dataset_id = dataset_id


class _Reader(DataSourceReader):
    """A partition for each dataset; its body is fetched by the task that reads it."""

    def __init__(self, options: dict[str, str], schema: StructType, fetch: Fetcher):
        self.ids, self.base, self.token = json.loads(options["ids"]), options["base"].rstrip("/"), options["token"]
        self.types, self.fetch = to_arrow_schema(schema), fetch

    def partitions(self) -> list[InputPartition]:
        return [_OneDataset(i) for i in self.ids]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        body = self.fetch(f"{self.base}/{partition.dataset_id}.csv", self.token, TIMEOUTS["data"])
        table = _arrow_csv(body, pa.schema([f for f in self.types if f.name != ID_COLUMN]))
        ids = pa.array([partition.dataset_id] * table.num_rows, pa.string())
        columns = [ids if n == ID_COLUMN else table[n] for n in self.types.names]
        yield from pa.Table.from_arrays(columns, schema=self.types).to_batches(max_chunksize=10_000)


ID_COLUMN = "dataset_id"
FORMAT = "tidemark_remote"


def remote_format(fetch: Fetcher = http_fetch) -> type[DataSource]:
    """The Spark format ``tidemark_remote``: register it, then read with options
    base, token and ids (a JSON list). Without a given schema, the columns of the
    first dataset count for all, after the column dataset_id."""

    class RemoteFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> StructType:
            first = json.loads(self.options["ids"])[0]
            body = fetch(f"{self.options['base'].rstrip('/')}/{first}.csv", self.options["token"], TIMEOUTS["data"])
            return StructType([StructField(ID_COLUMN, StringType()), *from_arrow_schema(_arrow_csv(body).schema).fields])

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(dict(self.options), schema, fetch)

    return RemoteFormat


@dataclass
class RemoteDataset:
    dataset_id: str
    name: str
    metadata: dict
    frame: DataFrame


class RemoteTables:
    """``<base>/<id>`` has metadata, ``<base>/<id>.csv`` the rows."""

    def __init__(self, base: str, key: str, fetch: Fetcher = http_fetch):
        self.base, self.key, self.fetch = base.rstrip("/"), key, fetch

    def valid_key(self) -> bool:
        try:
            self.fetch(self.base, self.key, TIMEOUTS["validate"])
        except (urllib.error.URLError, OSError, ValueError):
            return False
        return True

    def metadata(self, dataset_id: str) -> dict | None:
        try:
            return json.loads(self.fetch(f"{self.base}/{dataset_id}", self.key, TIMEOUTS["metadata"]))
        except (urllib.error.URLError, OSError, ValueError):
            return None

    def frame(self, spark: SparkSession, dataset_ids: list[str], schema: StructType | str | None = None) -> DataFrame:
        """The rows of several datasets, each read by a task of its own."""
        spark.dataSource.register(remote_format(self.fetch))
        reader = spark.read.format(FORMAT).option("base", self.base).option("token", self.key).option("ids", json.dumps(dataset_ids))
        return (reader.schema(schema) if schema else reader).load()

    def read(self, spark: SparkSession, dataset_id: str) -> RemoteDataset | None:
        """A dataset with its metadata; None where the service gives no such."""
        meta = self.metadata(dataset_id)
        if meta is None:
            return None
        try:
            rows = self.frame(spark, [dataset_id]).drop(ID_COLUMN)
        except (PySparkException, OSError):
            return None
        return RemoteDataset(dataset_id, str(meta.get("name", dataset_id)), meta, rows)
