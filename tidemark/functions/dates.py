"""Date texts: which format a column has, and Columns that parse each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in order, Spanish and English.
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
MONTHS_EN = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

SAMPLE = 100


def _names(months: list[str]) -> dict[str, int]:
    return {k: i for i, m in enumerate(months, 1) for k in (m, m[:3])}


MONTH_OF = {"es": _names(MONTHS_ES), "en": _names(MONTHS_EN)}


#: The accepted spellings of months in a date text.
SHORT_ES = "ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic"
SHORT_EN = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
LONG_ES = "|".join([*MONTHS_ES, SHORT_ES])
LONG_EN = "|".join([*MONTHS_EN, SHORT_EN])

#: Formats in the order in which a text is tried; the first that fits has it.
#: The accepted spellings.
FORMATS: dict[str, str] = {
    "timestamp": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*",
    "iso": r"\d{4}[-/]\d{2}[-/]\d{2}",
    "iso_week": r"\d{4}-W\d{2}",
    "year_month": r"\d{4}[-/](?:0[1-9]|1[0-2])",
    "campaign_year_span": r"\d{4}[/-](?:\d{4}|\d{2})",
    "year_only": r"\d{4}",
    "quarterly_q_year": r"(?i)Q[1-4]\s?\d{4}",
    "quarterly_year_q": r"(?i)\d{4}[-_]Q[1-4]",
    "quarterly_t_year": r"(?i)[1-4]T\s?\d{4}",
    "quarterly_year_t": r"(?i)\d{4}[-_]T[1-4]",
    "month_text_es_short": rf"(?i)(?:{SHORT_ES})-\d{{2}}",
    "month_text_es": rf"(?i)(?:{LONG_ES})\s+\d{{2,4}}",
    "month_text_en_short": rf"(?i)(?:{SHORT_EN})-\d{{2}}",
    "month_text_en": rf"(?i)(?:{LONG_EN})\s+\d{{2,4}}",
    "dmy": r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}",
}

HINTS = {"quarterly": "Q", "month_text": "M", "year_month": "M", "campaign": "A", "year_only": "A", "iso_week": "W"}


@dataclass(frozen=True)
class DateFormat:
    format: str = "iso"
    dayfirst: bool = False
    confidence: str = "low"
    frequency_hint: str = "D"


#: What formats of a fixed width look like with a 9 for each digit.
SHAPES = {
    "iso": ["9999-99-99", "9999/99/99", "9999-99/99", "9999/99-99"],
    "iso_week": ["9999-W99"],
    "year_month": ["9999-99", "9999/99"],
    "campaign_year_span": ["9999-99", "9999/99", "9999-9999", "9999/9999"],
    "year_only": ["9999"],
}


def _shape(text: Column) -> Column:
    """A text with a 9 for each digit: what a format of a fixed width is told by."""
    return F.translate(text, "012345678", "9" * 9)


def format_votes(text: Column) -> Column:
    """Name of the first format that a trimmed text fits; null if none does.

    The shape of the text settles formats of a fixed width; only texts of another
    shape are matched, form by form."""
    t = F.trim(text)
    shape = _shape(t)
    found = F.when(F.lit(False), None)
    for name, shapes in SHAPES.items():
        fits = shape.isin(shapes)
        if name == "year_month":
            fits = fits & F.substring(t, 6, 2).between("01", "12")
        found = found.when(fits, F.lit(name))
    others = ((name, form) for name, form in FORMATS.items() if name not in SHAPES)
    return reduce(lambda when, f: when.when(t.rlike(f"^(?:{f[1]})$"), F.lit(f[0])), others, found).cast("string")


def detect_date_format(df: DataFrame, column: str, sample: int = SAMPLE, strict: bool = False) -> DateFormat:
    """The format that most of the first values have.

    ``YYYY-MM`` texts count as months unless a year span in the sample says
    otherwise; ``strict`` takes them for year spans always."""
    kind = dict(df.dtypes)[column]
    if kind.startswith(("date", "timestamp")):
        return DateFormat("iso", False, "high", "D")
    values = [
        (r[0], r[1])
        for r in df.where(F.col(f"`{column}`").isNotNull())
        .select(F.trim(F.col(f"`{column}`").cast("string")).alias("v"))
        .limit(sample)
        .select("v", format_votes(F.col("v")))
        .toLocalIterator()
    ]
    votes: dict[str, int] = {}
    spans = strict or any(f == "campaign_year_span" for _, f in values)
    for _, f in values:
        f = "campaign_year_span" if f == "year_month" and spans else f
        if f:
            votes[f] = votes.get(f, 0) + 1
    if not votes:
        return DateFormat()
    winner = max(votes, key=votes.get)
    share = votes[winner] / len(values)
    confidence = "high" if share >= 0.9 else "medium" if share >= 0.6 else "low"
    dayfirst = winner == "dmy"
    if dayfirst:
        firsts = [int(re.match(r"\d+", v).group()) for v, f in values if f == "dmy"]
        confidence = "high" if max(firsts) > 12 else "medium"
    hint = next((h for prefix, h in HINTS.items() if winner.startswith(prefix)), "D")
    return DateFormat(winner, dayfirst, confidence, hint)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _first_of(year: Column, month: Column, day=1) -> Column:
    day = day if isinstance(day, Column) else F.lit(day)
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz")


#: Begins a text that was read by its form; no text to be read begins so.
_READ = "\x01"


def _reading(text: Column, form: str, order: str) -> tuple[Column, Column]:
    """(reading, fits) of a text in one match: its groups in the given order if it
    has the form. Their parts are then cut out by place, not matched again."""
    got = F.regexp_replace(text, f"^(?:{form})$", _READ + order)
    return F.substring(got, 2, 100), got.startswith(_READ) & ~text.startswith(_READ)


def parse_quarter(text: Column) -> Column:
    """Q1 2025, 2025-Q1, 1T2025, 2025-T1: the first day of the quarter."""
    form = r"Q([1-4])\s*(\d{4})|([1-4])T\s*(\d{4})|(\d{4})[-_][QT]([1-4])"
    got, fits = _reading(F.upper(F.trim(text)), form, "$2$4$5$1$3$6")  # year, quarter
    return F.when(fits, _first_of(_int(F.substring(got, 1, 4)), _int(F.substring(got, 5, 1)) * 3 - 2))


def month_number(text: Column, language: str) -> Column:
    """Number of a month by its name or the name's first three letters."""
    names = F.create_map(*[F.lit(x) for kv in MONTH_OF[language].items() for x in kv])
    name = F.lower(F.trim(text))
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(names, F.substring(name, 1, 3)))


def parse_month_text(text: Column, language: str) -> Column:
    """Enero 2025, Jan-25: the first of the month; two digits are of this century."""
    got, fits = _reading(F.trim(text), r"([A-Za-z]+)[-\s]+(?:(\d{2})|(\d{4}))", "20$2$3 $1")
    year = F.substring_index(got, " ", 1)  # 20 before two digits, or before all four
    return F.when(fits, _first_of(_int(F.right(year, F.lit(4))), month_number(F.substring_index(got, " ", -1), language)))


def parse_year_span(text: Column) -> Column:
    """2024/2025, 2024-25: the first day of the first year; the years must follow."""
    t = F.trim(text)
    start, end = _int(F.substring(t, 1, 4)), F.substring(t, 6, 4)
    follows = F.right((start + 1).cast("string"), F.length(end)) == end
    return F.when(_shape(t).isin(SHAPES["campaign_year_span"]) & follows, _first_of(start, F.lit(1)))


def parse_iso_week(text: Column) -> Column:
    """2025-W03: that week's Monday. Week 53 only in years that have one."""
    t = F.trim(text)
    year, week = _int(F.substring(t, 1, 4)), _int(F.substring(t, 7, 2))
    fourth = _first_of(year, F.lit(1), 4).cast("date")  # always in week 1
    monday = F.date_add(F.trunc(fourth, "WEEK"), (week - 1) * 7)
    fits = _shape(t).isin(SHAPES["iso_week"]) & week.between(1, 53)
    return F.when(fits & (F.year(F.date_add(monday, 3)) == year), monday.cast("timestamp_ntz"))


def parse_year_month(text: Column) -> Column:
    t = F.trim(text)
    return F.when(_shape(t).isin(SHAPES["year_month"]), _first_of(_int(F.substring(t, 1, 4)), _int(F.substring(t, 6, 2))))


def parse_year(text: Column) -> Column:
    t = F.trim(text)
    return F.when(_shape(t).isin(SHAPES["year_only"]), _first_of(_int(t), F.lit(1)))


def parse_iso(text: Column) -> Column:
    t = F.translate(F.trim(text), "/", "-")
    gate = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), t)
    return gate.try_cast("timestamp_ntz")


def parse_dmy(text: Column, dayfirst: bool = True) -> Column:
    got, fits = _reading(F.trim(text), r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", "$3-$1-$2")
    y, a, b = (_int(F.split_part(got, F.lit("-"), F.lit(i))) for i in (1, 2, 3))
    return F.when(fits, _first_of(y, b, a) if dayfirst else _first_of(y, a, b))


#: strptime codes and the pattern letters of the same meaning.
STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%f": "SSSSSS"}


def strptime_pattern(form: str) -> str:
    out = re.sub(r"%[A-Za-z]", lambda m: STRPTIME.get(m.group(), m.group()), form)
    return re.sub(r"(?<![A-Za-z])T(?![A-Za-z])", "'T'", out)


def parse_date(column: Column, fmt: DateFormat | str, dayfirst: bool = True) -> Column:
    """Timestamps of texts in a known format; texts of other forms become null.

    A format with ``%`` is a strptime pattern."""
    name = fmt.format if isinstance(fmt, DateFormat) else fmt
    dayfirst = fmt.dayfirst if isinstance(fmt, DateFormat) else dayfirst
    text = column.cast("string")
    if "%" in name:
        return F.try_to_timestamp(text, F.lit(strptime_pattern(name))).cast("timestamp_ntz")
    if name.startswith("quarterly"):
        return parse_quarter(text)
    if name.startswith("month_text"):
        return parse_month_text(text, "es" if "_es" in name else "en")
    one = {
        "campaign_year_span": parse_year_span,
        "iso_week": parse_iso_week,
        "year_month": parse_year_month,
        "year_only": parse_year,
    }.get(name)
    if one:
        return one(text)
    if name == "dmy":
        return parse_dmy(text, dayfirst)
    return parse_iso(text)


def parse_audit_date(df: DataFrame, column: str) -> Column:
    """Dates of an audited table: ``yyyy-MM-dd`` texts only, dates as they are."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind.startswith(("date", "timestamp")):
        return c.cast("timestamp_ntz")
    return F.when(F.trim(c.cast("string")).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(c.cast("string"))).try_cast("timestamp_ntz")


def compose_date(year: Column, period: Column, encoding: str) -> Column:
    """The first of the month that a year and a period name.

    Encodings: month_numeric, month_text_es, month_text_en, quarter_numeric,
    quarter_text_q, quarter_text_t. Anything unreadable is null."""
    text = period.cast("string")
    quarter = None
    if encoding == "month_numeric":
        month = text.try_cast("double").try_cast("int")
    elif encoding.startswith("month_text_"):
        month = month_number(text, encoding[-2:])
    elif encoding == "quarter_numeric":
        quarter = text.try_cast("double").try_cast("int")
    elif encoding in ("quarter_text_q", "quarter_text_t"):
        form = r"[qQ](\d)" if encoding.endswith("q") else r"(\d)[tT]"
        quarter = _int(F.nullif(F.regexp_extract(text, form, 1), F.lit("")))
    else:
        return F.lit(None).cast("timestamp_ntz")
    if quarter is not None:
        month = F.when(quarter.between(1, 4), quarter * 3 - 2)
    return _first_of(F.nullif(year.cast("string").try_cast("double").try_cast("int"), F.lit(0)), month)


def compose_date_column(df: DataFrame, year: str, period: str, encoding: str, order: str, out: str = "Date") -> DataFrame:
    """``compose_date`` with years carried down over blank cells, by ``order``.

    Carrying down needs the whole order at once, as a sheet has; for a table
    without blanks use ``compose_date`` on its own."""
    from pyspark.sql import Window as W

    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = F.last(F.col(year), ignorenulls=True).over(w)
    return df.withColumn("_year", filled).withColumn(out, compose_date(F.col("_year"), F.col(period), encoding)).drop("_year")


def detect_period_encoding(df: DataFrame, column: str, sample: int = 30) -> str:
    """How a period column is written, from its first values."""
    values = [str(r[0]).strip() for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).limit(sample).collect()]
    if any(re.fullmatch(r"(?i)q[1-4]", v) for v in values):
        return "quarter_text_q"
    if any(re.fullmatch(r"(?i)[1-4]t", v) for v in values):
        return "quarter_text_t"
    for language in ("es", "en"):
        if values and all(v.lower() in MONTH_OF[language] for v in values):
            return f"month_text_{language}"
    numbers = [float(v) for v in values if re.fullmatch(r"\d+(\.0)?", v)]
    return "quarter_numeric" if numbers and max(numbers) <= 4 else "month_numeric"
