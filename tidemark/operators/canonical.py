"""Any table as (Date, Key, Value), one row for each date and key."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers
from tidemark.operators import shape
from tidemark.sources.readers import nan_to_null, with_order, with_ordinals

ORDER = "_ord"


@dataclass
class Canonical:
    df: DataFrame
    date_column: str
    key_columns: list[str]
    value_column: str
    format: str
    log: list[str] = field(default_factory=list)


def canonicalize(df: DataFrame, side: dict[str, Any], order: str | None = None) -> Canonical:
    """Header, footer, null texts, dates, shape, key, number and scale, in this
    order; then the last row of each (Date, Key), by the order of rows.

    Rows without a readable date go; unreadable values are null. ``side`` takes
    date_column, key_columns, value_column or value_columns, format,
    normalizations, header_row, skip_rows_bottom, date_format, dayfirst,
    number_format, scale, custom_null_values."""
    log: list[str] = []
    df = nan_to_null(df)
    # a footer is cut off by place, so rows need places without gaps
    dense = not order and bool(side.get("skip_rows_bottom"))
    number_rows = with_ordinals if dense else with_order
    df = df.withColumn(ORDER, F.col(order)) if order and order != ORDER else (df if order else number_rows(df, ORDER))
    header = side.get("header_row")
    if header is None:
        header = shape.detect_header_row(df, ORDER)
    elif not all(c.lstrip("_c").isdigit() for c in df.columns if c != ORDER):
        header = None
    if header is not None:
        df = shape.reheader(df, header, ORDER)
        log.append(f"row {header} gave the column names")
    if side.get("skip_rows_bottom"):
        df = shape.drop_footer(df, side["skip_rows_bottom"], ORDER, dense)
        log.append(f"dropped {side['skip_rows_bottom']} rows at the end")
    df = numbers.null_texts_to_null(df, side.get("custom_null_values"))

    date = side.get("date_column", "Date")
    keys = [c for c in side.get("key_columns") or [] if c in df.columns]
    wide = side.get("format", "long") == "wide"
    values = [c for c in side.get("value_columns") or [] if c in df.columns] if wide else [side.get("value_column", "Value")]

    fmt: dates.DateFormat | str
    if side.get("date_format"):
        fmt = dates.DateFormat(side["date_format"], bool(side.get("dayfirst", True)))
    else:
        fmt = dates.detect_date_format(df, date)
        if side.get("dayfirst") is not None and fmt.format == "dmy":
            fmt = dates.DateFormat(fmt.format, bool(side["dayfirst"]), fmt.confidence, fmt.frequency_hint)
    log.append(f"dates read as {fmt.format}")
    typed = dict(df.dtypes)[date].startswith(("date", "timestamp"))
    df = df.withColumn("_date", K(date).cast("timestamp_ntz") if typed else dates.parse_date(K(date), fmt))
    df = df.where("_date is not null")

    given = side.get("number_format")
    number = numbers.NumberFormat(**given) if given else None
    parsed = {}
    for c in values:
        if numbers.is_numeric(dict(df.dtypes)[c]):
            parsed[c] = K(c).cast("double")
        else:
            f = number or numbers.detect_number_format(df, c)
            log.append(f"{c}: {f}")
            parsed[c] = numbers.parse_number(K(c), f)
    df = df.select("_date", *[K(c) for c in keys], *[x.alias(c) for c, x in parsed.items()], ORDER)
    value = values[0]
    if wide:
        df = df.unpivot(["_date", *[K(c) for c in keys], ORDER], [K(c) for c in values], "_key_wide", "Value")
        keys, value = [*keys, "_key_wide"], "Value"
    norm = side.get("normalizations") or {}
    text = shape.key(keys, norm.get("lowercase_keys", True), norm.get("strip_keys", True))
    scale = side.get("scale") or 1
    out = df.select(F.col("_date").alias("Date"), text.alias("Key"), (K(value) * F.lit(float(scale))).alias("Value"), ORDER)
    out = shape.keep_one(out, ["Date", "Key"], ORDER, last=True).drop(ORDER)
    return Canonical(out, date, keys, value, "wide" if wide else "long", log)


def K(name: str):
    return F.col(f"`{name}`")
