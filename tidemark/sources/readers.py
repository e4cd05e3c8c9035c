"""Readers of tables: CSV, Parquet, Excel where its library is there."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.shared import written

SEPARATORS = {"Comma": ",", "Semicolon": ";", "Tab": "\t", "Pipe": "|"}


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The delimiter that the first lines show; a comma where none is clear."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())[:4096]
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, sep: str = "Auto", infer: bool = True, header: bool = True) -> DataFrame:
    """CSV with a header; ``sep`` is Auto, a name of SEPARATORS, or the sign itself."""
    sign = sniff_separator(spark, path) if sep == "Auto" else SEPARATORS.get(sep, sep)
    return spark.read.csv(path, sep=sign, header=header, inferSchema=infer, multiLine=False)


def _sheet(content: bytes, sheet: str | int):
    """A sheet of a workbook as a pandas table; needs a workbook library."""
    import pandas as pd

    return pd.read_excel(io.BytesIO(content), sheet_name=sheet)


SheetReader = Callable[[bytes, str | int], Any]


def read_sheets(spark: SparkSession, path: str, sheets: list[str | int], schema: str | None = None, parse: SheetReader = _sheet) -> DataFrame:
    """Sheets of a workbook, one task a sheet, under a column ``sheet``.

    A task reads the workbook's bytes and parses its sheet; only the columns of
    the first sheet, which count for all if no ``schema`` is given, reach the
    driver. Columns are matched by name; what a sheet lacks is null."""
    import pandas as pd

    names = spark.createDataFrame([(str(x), isinstance(x, int)) for x in sheets], "sheet string, by_number boolean")
    books = spark.read.format("binaryFile").load(path).select("content")
    each = books.crossJoin(F.broadcast(names)).repartition(len(sheets), "sheet")  # the few sheets that were asked for

    def one(content: bytes, sheet: str, by_number: bool) -> pd.DataFrame:
        frame = parse(content, int(sheet) if by_number else sheet)
        frame.columns = [str(c) for c in frame.columns]
        return frame

    def kinds(batches):
        for batch in batches:
            for row in batch.itertuples():
                told = pa.Schema.from_pandas(one(row.content, row.sheet, row.by_number), preserve_index=False)
                yield pd.DataFrame({"told": [from_arrow_schema(told).json()]})

    if schema is None:
        first = each.where((F.col("sheet") == str(sheets[0])) & (F.col("by_number") == isinstance(sheets[0], int)))
        wanted = StructType.fromJson(json.loads(first.mapInPandas(kinds, "told string").first()["told"]))
    else:
        wanted = StructType.fromDDL(schema)

    def rows(batches):
        for batch in batches:
            for row in batch.itertuples():
                frame = one(row.content, row.sheet, row.by_number).reindex(columns=wanted.names)
                frame.insert(0, "sheet", row.sheet)
                yield frame

    return each.mapInPandas(rows, StructType([StructField("sheet", StringType()), *wanted.fields]))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook, read by a task."""
    return read_sheets(spark, path, [sheet]).drop("sheet")


def read_table(spark: SparkSession, path: str, sep: str = "Auto") -> DataFrame:
    """By suffix: Parquet, ORC, JSON, Excel; anything else as CSV."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "pq"):
        frame = spark.read.parquet(path)
    elif suffix == "orc":
        frame = spark.read.orc(path)
    elif suffix in ("json", "jsonl"):
        frame = spark.read.json(path)
    elif suffix in ("xlsx", "xls", "xlsb"):
        frame = read_excel(spark, path)
    else:
        frame = read_csv(spark, path, sep)
    return nan_to_null(frame)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this engine."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) for c in floats}) if floats else df


def _with_splits(df: DataFrame) -> DataFrame | None:
    """``df`` with the file and split of each row; None where its rows are not
    read from files as they stand."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:
        return None


def with_order(df: DataFrame, column: str = "_ord") -> DataFrame:
    """The order in which rows stand, as a column: of several files, by their
    paths and by the place in each; otherwise as they are read. It is an ordinal,
    not a count, where no file order has to be set up."""
    placed = _with_splits(df) if len(df.inputFiles()) > 1 else None
    return df.withColumn(column, F.monotonically_increasing_id()) if placed is None else _numbered(df.columns, placed, column)


def with_ordinals(df: DataFrame, column: str = "_ord") -> DataFrame:
    """The place of every row from 0, without gaps, in order of file path and
    place in the file. Rows that are not read from files are written to the shared
    folder first, as their partitions may fall otherwise when they are made again."""
    placed = _with_splits(df)
    if placed is not None:
        return _numbered(df.columns, placed, column)
    held = written(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    return _numbered(df.columns, held.withColumns({"_file": F.lit(""), "_start": F.shiftright("_id", 33)}), column)


def _numbered(columns: list[str], placed: DataFrame, column: str) -> DataFrame:
    """Rows are counted by file and split first; a split's offset is the sum of
    those before it, so no row is sorted. There are as many counts as splits."""
    if "_id" not in placed.columns:
        placed = placed.withColumn("_id", F.monotonically_increasing_id())
    counts = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    place = (F.col("_id") + F.col("_offset")).alias(column)
    return placed.join(offsets, ["_file", "_start"]).select(*[F.col(f"`{c}`") for c in columns], place)
