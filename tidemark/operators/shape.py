"""Long, wide and transposed tables brought to one shape."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates


def value_columns(columns: list[str], config: dict[str, Any]) -> list[str]:
    named = config["value_columns"] if config.get("format") == "wide" else [config.get("value_column")]
    return [c for c in named or [] if c in columns]


def dimension_columns(columns: list[str], config: dict[str, Any]) -> list[str]:
    return [c for c in config.get("dimension_columns") or [] if c in columns]


def detect_format(columns: list[str], config: dict[str, Any]) -> str:
    if config.get("format"):
        return config["format"]
    return "long" if {"Value", config.get("value_column")} & set(columns) else "wide"


def wide_to_long(df: DataFrame, date: str, values: list[str], variable: str = "variable", value: str = "Value") -> DataFrame:
    """A row for each value column; every other column stays as an id. Nulls stay."""
    ids = [c for c in df.columns if c not in values]
    typed = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in values})
    return typed.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], variable, value)


def to_long(df: DataFrame, config: dict[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """The table in long format, with the config that describes it."""
    if detect_format(df.columns, config) == "long":
        return df, {**config, "format": "long"}
    present = [c for c in config["value_columns"] if c in df.columns]
    long_ = wide_to_long(df, config["date_column"], present)
    dims = [*(config.get("dimension_columns") or []), "variable"]
    return long_, {**config, "format": "long", "value_column": "Value", "dimension_columns": dims}


def transposed_to_long(df: DataFrame, entity: str, header_dates: dict[str, Any]) -> DataFrame:
    """(series_name, date, value) of a table with dates as column headers."""
    columns = [c for c in df.columns if c in header_dates]
    name = F.trim(F.col(f"`{entity}`").cast("string"))
    kept = df.where(F.col(f"`{entity}`").isNotNull() & ~F.lower(name).isin("", "nan", "none"))
    texts = kept.select(name.alias("series_name"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long_ = texts.unpivot("series_name", [F.col(f"`{c}`") for c in columns], "header", "raw")
    when = F.create_map(*[F.lit(x) for c in columns for x in (c, header_dates[c])])
    return long_.select("series_name", when[F.col("header")].cast("timestamp_ntz").alias("date"), "raw")


def reheader(df: DataFrame, row: int, order: str) -> DataFrame:
    """Row ``row`` (from 0) gives the names; it and those above it go."""
    own = [c for c in df.columns if c != order]
    ranked = df.orderBy(order).limit(row + 1).collect()
    names = [str(ranked[row][c]) if ranked[row][c] is not None else c for c in own]
    below = df.where(F.col(order) > F.lit(ranked[row][order]))
    return below.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)], order)


def detect_header_row(df: DataFrame, order: str, scan: int = 20) -> int | None:
    """The row with most texts that are not numbers, of the first ``scan``; the
    later of equals. Only for tables whose columns have no names but numbers."""
    own = [c for c in df.columns if c != order]
    if not all(c.lstrip("_c").isdigit() for c in own):
        return None

    def numeric(x: str) -> bool:
        try:
            float(x.replace(",", "."))
        except ValueError:
            return False
        return True

    best, at = 0, None
    for i, row in enumerate(df.orderBy(order).limit(scan).collect()):
        score = sum(1 for c in own if row[c] is not None and str(row[c]).strip() and not numeric(str(row[c]).strip()))
        if score >= best and score:
            best, at = score, i
    return at


def drop_footer(df: DataFrame, n: int, order: str, dense: bool = False) -> DataFrame:
    """Without the last ``n`` rows, if there are more than that.

    ``dense``: ``order`` has no gaps, so the last rows are told by their number
    alone; otherwise the last ``n`` are looked for."""
    if n <= 0:
        return df
    if dense:
        ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
        return df if ends["a"] is None or ends["b"] - ends["a"] < n else df.where(F.col(order) <= F.lit(ends["b"] - n))
    if df.count() <= n:
        return df
    last = df.select(order).orderBy(F.desc(order)).limit(n).agg(F.min(order).alias("cut")).first()["cut"]
    return df.where(F.col(order) < F.lit(last))


def key(columns: list[str], lower: bool = True, strip: bool = True, null: str = "<na>") -> Column:
    """One text of all key columns, ``_total_`` without any; nulls have a text."""
    if not columns:
        return F.lit("_total_")

    def one(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        text = F.trim(text) if strip else text
        return F.coalesce(F.lower(text) if lower else text, F.lit(null))

    return F.concat_ws("|", *map(one, columns))


def series_key(columns: list[str]) -> Column:
    if not columns:
        return F.lit("(all)")
    return F.concat_ws(" | ", *[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("nan")) for c in columns])


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    """The first or last row of each key, by ``order``."""
    w = W.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def header_dates(columns: list[str], spark) -> dict[str, Any]:
    """Timestamps of the headers that read as dates."""
    frame = spark.createDataFrame([(c,) for c in columns], "header string")
    fmt = dates.detect_date_format(frame, "header", len(columns))
    rows = frame.select("header", dates.parse_date(F.col("header"), fmt).alias("d")).collect()
    return {r["header"]: r["d"] for r in rows if r["d"] is not None}
