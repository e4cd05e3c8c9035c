import datetime as dt

import pytest

from tidemark.operators import compare, series
from tidemark.operators.canonical import canonicalize
from tidemark.report import load_matching, render_html, save_matching

SIDE = {"date_column": "Date", "key_columns": ["Region"], "value_column": "Value"}
BOTH = {"source": SIDE, "platform": SIDE}


def table(spark, rows, names="Date string, Region string, Value double"):
    return spark.createDataFrame(rows, names).coalesce(1)


def rows(n=10, factor=1.0, shift=0):
    start = dt.date(2024, 1, 1)
    return [(str(start + dt.timedelta(i + shift)), r, factor * (100 + 37 * i % 91 + j)) for i in range(n) for j, r in enumerate(("CABA", "GBA"))]


def test_equal_tables_match(spark):
    report = compare.compare_datasets(table(spark, rows()), table(spark, rows()), BOTH)
    assert report.match_pct == 1.0 and report.joined_rows == 20 and report.different == 0
    assert report.to_serializable_dict()["matched"] == 20 and "100.00%" in render_html(report)


def test_differences_coverage_and_nulls(spark):
    other = [(d, r, v * 1.5 if d == "2024-01-03" else v) for d, r, v in rows() if d != "2024-01-05"] + [("2024-01-02", "X", 1.0)]
    other[0] = (*other[0][:2], None)
    report = compare.compare_datasets(table(spark, rows()), table(spark, other), BOTH)
    assert report.different == 3 and report.coverage["missing_dates"] == 1 and report.coverage["extra_keys"] == 1
    assert report.all_diffs.where("not matched").count() == 3
    assert compare.filter_diffs(report.all_diffs, "caba", 10).count() == 1


@pytest.mark.parametrize("factor", [1000.0, 0.01])
def test_scale_is_found_and_corrected(spark, factor):
    report = compare.compare_datasets(table(spark, rows()), table(spark, rows(factor=factor)), BOTH)
    assert report.scale["scale_factor"] == factor and report.scale["confidence"] == "high" and report.match_pct > 0.9


def test_scale_verdicts():
    assert compare.judge_scale({"n": 2, "median": 1.0})["label"] == "insufficient data"
    assert compare.judge_scale({"n": 9, "median": -1.0})["confidence"] is None
    even = {"n": 9, "median": 1.0, "near_n": 9, "near_median": 1.01, "near_std": 0.0}
    assert compare.judge_scale(even)["confidence"] is None


def test_shift_by_a_day_is_found(spark):
    report = compare.compare_datasets(table(spark, rows()), table(spark, rows(shift=1)), BOTH)
    assert report.temporal_shift == -1
    assert compare.compare_datasets(table(spark, rows()), table(spark, rows()), BOTH).temporal_shift is None


def test_no_overlap_gives_zeros(spark):
    report = compare.compare_datasets(table(spark, rows(3)), table(spark, rows(3, shift=100)), BOTH)
    assert (report.joined_rows, report.match_pct, report.scale) == (0, 0.0, {})


def test_columns_map_by_name(spark):
    other = table(spark, rows(), "date string, region string, value double")
    assert compare.compare_datasets(table(spark, rows()), other, {"source": SIDE}).match_pct == 1.0


def test_canonical_keeps_the_last_row_and_writes_nulls(spark):
    df = table(spark, [("2024-01-01", " A ", 1.0), ("2024-01-01", "a", 2.0), ("2024-01-01", None, 3.0), ("bad", "a", 9.0)])
    got = {(r["Key"], r["Value"]) for r in canonicalize(df, SIDE).df.collect()}
    assert got == {("a", 2.0), ("<na>", 3.0)}
    wide = spark.createDataFrame([("01/02/2024", "1.234,5", "n/a")], "Date string, X string, Y string")
    side = {"date_column": "Date", "format": "wide", "value_columns": ["X", "Y"], "scale": 10}
    got = {(r["Date"], r["Key"], r["Value"]) for r in canonicalize(wide, side).df.collect()}
    assert got == {(dt.datetime(2024, 2, 1), "x", 12345.0), (dt.datetime(2024, 2, 1), "y", None)}


def test_junk_above_and_below_the_table(spark):
    df = spark.createDataFrame(
        [(0, "Report", None), (1, "Date", "Value"), (2, "2024-01-01", "5"), (3, "2024-01-02", "6"), (4, "2024-01-03", "7")], "o long, `0` string, `1` string"
    )
    got = canonicalize(df.withColumnRenamed("o", "_ord"), {"date_column": "Date", "value_column": "Value", "skip_rows_bottom": 1}, "_ord")
    assert sorted(r["Value"] for r in got.df.collect()) == [5.0, 6.0]


# Series.


def points(spark, named):
    data = [(n, dt.datetime(2024, m, 1), float(v), m) for n, vs in named.items() for m, v in enumerate(vs, 1)]
    return spark.createDataFrame(data, "series_name string, date timestamp_ntz, value double, ord long")


UP, DOWN, WAVE = [1, 2, 3, 4, 5, 6, 7, 9], [9, 7, 6, 5, 4, 3, 2, 1], [1, 5, 2, 8, 1, 9, 2, 7]


def test_extractors_agree(spark):
    wide = spark.createDataFrame([(f"2024-{m:02}-01", m, m * 2.0, "x") for m in range(1, 7)], "Date string, GDP long, CPI double, Notes string")
    got = series.extract_wide(wide, "Date", ["GDP", "CPI"])
    assert got.ignored == ["Notes"] and {r["series_name"]: r["row_count"] for r in got.meta().collect()} == {"GDP": 6, "CPI": 6}
    long_ = spark.createDataFrame([(f"2024-{m:02}-01", c, m * 1.0, m) for m in range(1, 4) for c in ("AR", "BR")], "Date string, Country string, V double, U int")
    assert {r["series_name"] for r in series.extract_long(long_, "Date", ["Country"], "V").meta().collect()} == {"AR", "BR"}
    multi = series.extract_long_multi(long_, "Date", ["Country"], ["V", "U"])
    assert {r["series_name"] for r in multi.meta().collect()} == {"AR | V", "AR | U", "BR | V", "BR | U"}
    assert series.extract_long_multi(long_, "Date", [], []).points.count() == 0
    flat = spark.createDataFrame([("A", "1", "2"), (None, "3", "4"), ("B", "5", None)], "Entity string, `2024-01-01` string, `2024-02-01` string")
    assert series.extract_transposed(flat).points.count() == 3
    assert series.extract_auto(long_).format == "long" and series.extract_auto(wide.drop("Notes")).format == "wide"
    assert series.extract_long(long_, "Date", [], "V").points.first()["series_name"] == "(all)"


def test_correlation_then_names(spark):
    source = points(spark, {"gdp": UP, "cpi": WAVE, "Rate A": [1, 1, 1, 1, 1, 1, 1, 1], "left": DOWN})
    platform = points(spark, {"PIB": [v * 10 for v in UP], "inflation": [v + 3 for v in WAVE], "rate_a": [2, 2, 2, 2, 2, 2, 2, 2]})
    found = series.match_series(source, platform)
    assert {(m.source, m.platform, m.match_type) for m in found.matches} == {
        ("gdp", "PIB", "correlation"), ("cpi", "inflation", "correlation"), ("Rate A", "rate_a", "name_only")
    }
    assert found.unmatched_source == ["left"] and found.summary()["match_rate_platform"] == 1.0


def test_names_settle_ties_and_short_overlap_is_ignored(spark):
    source = points(spark, {"alpha": UP, "beta": UP})
    found = series.match_series(source, points(spark, {"Beta": UP, "Alpha": UP}))
    assert {(m.source, m.platform) for m in found.matches} == {("alpha", "Alpha"), ("beta", "Beta")}
    assert series.correlations(points(spark, {"a": UP[:4]}), points(spark, {"b": UP})).count() == 0


def test_manual_matches_give_partners_back(spark, tmp_path):
    source, platform = points(spark, {"a": UP, "b": WAVE}), points(spark, {"x": UP, "y": WAVE})
    found = series.match_series(source, platform)
    manual = series.apply_manual(found, [("a", "y"), ("zz", "x")])
    assert [(m.source, m.platform) for m in manual.matches] == [("a", "y")]
    assert manual.unmatched_source == ["b"] and manual.unmatched_platform == ["x"]
    assert series.drop_matches(manual, ["y"]).unmatched_platform == ["x", "y"]
    save_matching(found, tmp_path / "m.yaml", 0.02)
    again, tolerance = load_matching(tmp_path / "m.yaml", ["a", "b"], ["x"])
    assert tolerance == 0.02 and [(m.source, m.platform) for m in again.matches] == [("a", "x")] and again.unmatched_source == ["b"]


def test_matched_series_are_compared(spark):
    source = points(spark, {"a": UP, "b": WAVE})
    platform = points(spark, {"a": [v * 1000 for v in UP], "b": [*WAVE[:-1], 70]})
    report = series.compare_matched(source, platform, series.match_series(source, platform, 0.95))
    by = {r["source"]: r for r in report.series_summary}
    assert by["a"]["match_pct"] == 1.0 and by["a"]["scale"]["scale_factor"] == 1000.0
    assert by["b"]["matched"] == 7 and report.top_diffs[0]["source"] == "b"
    reasons = {r[0]: r[1] for r in series.discard_reasons(points(spark, {"c": [1, 1], "o": [1], "f": UP})).collect()}
    assert reasons == {"c": "constant", "o": "one point", "f": None}
