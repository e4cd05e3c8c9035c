"""Names of columns and series brought to one form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_name(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_\-.]", " ", name.strip().lower())).strip()


def series_name(name: str) -> str:
    return re.sub(r"[_\-.|,;:\s]+", " ", name.strip().lower()).strip()


def series_name_column(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"[_\-.|,;:\s]+", " "))
