import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendars, dates, numbers


def day(y, m=1, d=1):
    return dt.datetime(y, m, d)


@pytest.mark.parametrize(
    "name, texts, expected",
    [
        ("quarterly_q_year", ["Q1 2025", "2025-Q2", "3T2025", "2025-T4", "Q5 2025"], [day(2025), day(2025, 4), day(2025, 7), day(2025, 10), None]),
        ("month_text_es", ["Enero 2025", "Ago-24", "dic 99", "foo 2025"], [day(2025), day(2024, 8), day(2099, 12), None]),
        ("month_text_en", ["January 2025", "Aug-24", "May 2023"], [day(2025), day(2024, 8), day(2023, 5)]),
        ("campaign_year_span", ["2024/2025", "2024-25", "1999-00", "2024/2026"], [day(2024), day(2024), day(1999), None]),
        ("iso_week", ["2025-W03", "2020-W53", "2021-W53", "2025-W00"], [day(2025, 1, 13), day(2020, 12, 28), None, None]),
        ("year_only", ["2025", "20x5"], [day(2025), None]),
        ("year_month", ["2025-03", "2025-13"], [day(2025, 3), None]),
        ("dmy", ["13/02/2025", "1.2.2025", "32/01/2025"], [day(2025, 2, 13), day(2025, 2, 1), None]),
        ("iso", ["2025-03-05", "2025/03/05", "nonsense", "2025-02-30"], [day(2025, 3, 5), day(2025, 3, 5), None, None]),
        ("%d-%m-%Y", ["05-03-2025", "x"], [day(2025, 3, 5), None]),
    ],
)
def test_date_texts(spark, name, texts, expected):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = frame.select("i", dates.parse_date(F.col("t"), name).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == expected


@pytest.mark.parametrize(
    "texts, name, hint",
    [
        (["2025-01-05"] * 3, "iso", "D"), (["Q1 2025", "Q2 2025"], "quarterly_q_year", "Q"),
        (["Ene 2025", "Feb 2025"], "month_text_es", "M"), (["Jan 2025", "Apr 2025"], "month_text_en", "M"),
        (["2024/2025"], "campaign_year_span", "A"), (["2025-03", "2025-04"], "year_month", "M"),
        (["2025-W01"], "iso_week", "W"), (["13/01/2025"], "dmy", "D"), (["zzz"], "iso", "D"),
    ],
)
def test_date_format_votes(spark, texts, name, hint):
    found = dates.detect_date_format(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert (found.format, found.frequency_hint) == (name, hint)


def test_day_first_confidence(spark):
    sure = dates.detect_date_format(spark.createDataFrame([("13/01/2025",)], "t string"), "t")
    unsure = dates.detect_date_format(spark.createDataFrame([("03/01/2025",)], "t string"), "t")
    assert (sure.confidence, unsure.confidence, unsure.dayfirst) == ("high", "medium", True)


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["1.234,56", "12,5"], [1234.56, 12.5]), (["$1,234.56", "$2"], [1234.56, 2.0]), (["€1.234,56"], [1234.56]),
        (["15.5%", "3%"], [15.5, 3.0]), (["(500)", "20"], [-500.0, 20.0]), (["12,5", "7"], [12.5, 7.0]),
        (["1.234", "12.5"], [1.234, 12.5]), (["AR$ 1.234,56"], [1234.56]), (["abc", "1e3", "inf", "1.5d"], [None, 1000.0, None, None]),
    ],
)
def test_number_texts(spark, texts, expected):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fmt = numbers.detect_number_format(frame, "t")
    got = frame.select("i", numbers.parse_number(F.col("t"), fmt).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == expected


@pytest.mark.parametrize(
    "encoding, period, month",
    [
        ("month_numeric", "11", 11), ("month_text_es", "Marzo", 3), ("month_text_en", "Mar", 3),
        ("quarter_numeric", "2", 4), ("quarter_text_q", "Q3", 7), ("quarter_text_t", "4T", 10),
    ],
)
def test_composed_dates(spark, encoding, period, month):
    frame = spark.createDataFrame([(0, "2024", period), (1, None, period), (2, "x", period)], "i int, y string, p string")
    got = dates.compose_date_column(frame, "y", "p", encoding, "i").orderBy("i").collect()
    assert [r["Date"] for r in got] == [day(2024, month), day(2024, month), None]
    assert dates.detect_period_encoding(frame, "p").split("_")[0] == encoding.split("_")[0]


def test_frequencies(spark):
    def of(days):
        return calendars.infer_frequency(spark.createDataFrame([(d,) for d in days], "day date"))

    start = dt.date(2024, 1, 1)
    assert of([start + dt.timedelta(i) for i in range(14)]) == "D"
    assert of([d for i in range(14) if (d := start + dt.timedelta(i)).weekday() < 5]) == "B"
    assert of([start + dt.timedelta(7 * i) for i in range(6)]) == "W"
    assert of([dt.date(2024, m, 1) for m in range(1, 13)]) == "M"
    assert of([dt.date(2024, m, 1) for m in (1, 4, 7, 10)]) == "Q"
    assert of([dt.date(y, 1, 1) for y in (2022, 2023, 2024)]) == "A"
    assert of([start]) is None
