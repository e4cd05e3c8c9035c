import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import ConfigError, config_from_dict, load_config, save_config, validate
from tidemark.operators import autodetect
from tidemark.operators.audit import audit_dataset
from tidemark.operators.autodetect import apply_profile, auto_detect_config, map_columns, strip_internal
from tidemark.report import exit_code, filter_checks, render_console, write_json
from tidemark.sources import readers, snapshots
from tidemark.sources.remote import KeyStore, RemoteTables

AS_OF = dt.date(2024, 4, 1)
CONFIG = {
    "dataset_name": "sales", "dimension_columns": ["Region"], "expected_frequency": "B", "allow_zero_values": False,
    "value_range": {"min": 0, "max": 1000}, "expected_dimensions": {"Region": ["N", "S"]}, "acceptable_lag_days": 10,
}


def business_days(n, start=dt.date(2024, 1, 2)):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += dt.timedelta(1)
    return out


def clean(n=60):
    return [(str(d), r, 100.0 + (i * 7 + j) % 13) for i, d in enumerate(business_days(n)) for j, r in enumerate("NS")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "Date string, Region string, Value double").coalesce(1)


def audit(spark, rows, before=None, **more):
    return {c.check_id: c for c in audit_dataset(frame(spark, rows), CONFIG | more, before, AS_OF).checks}


def test_clean_table_passes(spark):
    report = audit_dataset(frame(spark, clean()), CONFIG, as_of=AS_OF)
    assert report.total_checks == 19 and report.blockers == 0 and report.warnings == 0, render_console(report, False)
    assert exit_code(report) == 0
    assert all(c.details.get("skipped") for c in report.checks if c.category == "consistency")


def test_gaps_duplicates_nulls_zeros_and_outliers_are_found(spark):
    rows = [r for r in clean() if r[0] != "2024-01-10"]
    rows += [rows[0], ("2024-02-01", "N", 0.0), ("2024-02-02", "S", None), ("2024-02-05", "N", 99999.0), ("2024-02-06", "X", 100.0)]
    rows += [("2024-02-07", "S", None)] * 10
    checks = audit(spark, rows)
    failed = {k for k, c in checks.items() if not c.passed}
    assert failed == {"S3", "T2", "T3", "I1", "I2", "I3", "I4", "A1", "A2"}
    assert checks["T2"].details == {"gap_count": 1, "gaps_sample": ["2024-01-10"]}
    assert checks["I3"].details["exact_duplicate_count"] == 10
    assert checks["S3"].details == {"Region_new": ["X"]}
    assert checks["I4"].details["Value_above_max"] == 1
    assert checks["A1"].details["Value"]["count"] == 1
    assert checks["I2"].details == {"zero_counts": {"Value": 1}}


def test_changes_from_zero_are_infinite_and_zero_to_zero_are_none(spark):
    days = business_days(5)
    rows = [(str(d), "N", v) for d, v in zip(days, [0.0, 0.0, 5.0, None, 5.0], strict=True)]
    details = audit(spark, rows)["A2"].details
    assert details["Value"]["count"] == 1 and details["Value"]["max_pct_change"] == float("inf")


def test_no_dates_leave_thirteen_checks(spark):
    assert audit_dataset(frame(spark, [("bad", "N", 1.0)]), CONFIG, as_of=AS_OF).total_checks == 13
    assert audit_dataset(frame(spark, []), CONFIG, as_of=AS_OF).blockers == 0
    lost = audit_dataset(frame(spark, clean()).drop("Date"), CONFIG, as_of=AS_OF)
    assert [c.passed for c in lost.checks if c.check_id == "S1"] == [False]


def test_revisions_against_a_snapshot(spark):
    before = frame(spark, clean())
    rows = [(d, r, v * 2 if d < "2024-01-05" else v) for d, r, v in clean()]
    whitelist = {"enabled": True, "max_revision_age_days": 10, "max_revision_pct": 0.5}
    checks = audit(spark, rows, before, revision_whitelist=whitelist)
    assert checks["C1"].details["changed_rows"] == 6 and not checks["C1"].passed
    assert checks["C3"].details["old_revisions_beyond_age"] == 6 and not checks["C3"].passed
    assert checks["C2"].passed
    assert audit(spark, clean(), before)["C1"].passed


def test_staleness_range_and_overrides(spark):
    checks = audit(spark, clean(), acceptable_lag_days=0, expected_start="2023-12-01", severity_overrides={"T4": "BLOCKER"})
    assert checks["T4"].severity == "BLOCKER" and checks["T4"].details["days_stale"] == (AS_OF - business_days(60)[-1]).days
    assert not checks["T5"].passed


def test_wide_tables_are_audited_by_variable(spark):
    rows = [(str(d), float(i), float(i * 2)) for i, d in enumerate(business_days(30), 1)]
    wide = spark.createDataFrame(rows, "Date string, Sales double, Units double")
    config = {"dataset_name": "w", "format": "wide", "value_columns": ["Sales", "Units"], "expected_frequency": "B"}
    checks = {c.check_id: c for c in audit_dataset(wide, config, as_of=AS_OF).checks}
    assert checks["A3"].details["Value"]["count"] == 60 and checks["T3"].passed
    config["value_columns"] = ["Lost"]
    assert not next(c for c in audit_dataset(wide, config, as_of=AS_OF).checks if c.check_id == "S1").passed


def test_detected_settings_can_be_audited(spark):
    rows = [(str(d), r, float(i + 1)) for i, d in enumerate(business_days(30)) for r in ("Norte", "Sur")]
    df = spark.createDataFrame(rows, "Periodo string, Region string, Ventas double")
    config = auto_detect_config(df, "sales", AS_OF)
    assert (config["date_column"], config["value_column"], config["dimension_columns"]) == ("Periodo", "Ventas", ["Region"])
    assert config["expected_frequency"] == "B" and config["expected_dimensions"] == {"Region": ["Norte", "Sur"]}
    assert config["max_null_pct"] == 0.02 and config["expected_start"] == "2024-01-02"
    assert audit_dataset(df, strip_internal(config), as_of=AS_OF).blockers == 0
    never = auto_detect_config(spark.createDataFrame([("x", 1.0)], "a string, b double"), "n", AS_OF)
    assert never["date_column"] is None and never["expected_start"] is None


def test_ids_are_no_values_and_several_numbers_are_wide(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit("2024-01-01").alias("Date"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    config = auto_detect_config(df, "x", AS_OF)
    assert config["format"] == "wide" and config["value_columns"] == ["a", "b"]


def test_column_maps_and_profile():
    found = {m.source: (m.platform, m.score) for m in map_columns(["Date", "Region_Name", "Value", "Q"], ["date", "region name", "Value"])}
    assert found == {"Date": ("date", 0.95), "Region_Name": ("region name", 0.8), "Value": ("Value", 1.0), "Q": (None, 0.0)}
    side = apply_profile({"source": {"key_columns": ["k"]}, "platform": {"number_format": {"decimal": ","}}})["platform"]
    assert side["key_columns"] == ["k"] and side["number_format"]["decimal"] == "," and side["number_format"]["thousands"] == ","


def test_config_files(tmp_path):
    save_config(config_from_dict({"dataset_name": "x", "_notes": 1, "value_range": {"min": 1}}), tmp_path / "c.yaml")
    loaded = load_config(tmp_path / "c.yaml")
    assert loaded["value_range"] == {"min": 1, "max": None} and "_notes" not in loaded
    for bad in ({"format": "tall"}, {"expected_frequency": "X"}, {"dataset_name": ""}, {"format": "wide"}):
        with pytest.raises(ConfigError):
            validate(config_from_dict({"dataset_name": "x"} | bad))


def test_readers_snapshots_and_reports(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Date;Region;Value\n2024-01-02;N;1.5\n2024-01-03;S;\n")
    df = readers.read_table(spark, str(path))
    assert df.columns == ["Date", "Region", "Value"] and df.count() == 2
    assert snapshots.load_snapshot(spark, str(tmp_path), "none") is None
    snapshots.save_snapshot(df, str(tmp_path), "a b")
    again = snapshots.load_snapshot(spark, str(tmp_path), "a b")
    snapshots.save_snapshot(again.unionAll(df), str(tmp_path), "a b")  # read and replaced by one plan
    assert snapshots.load_snapshot(spark, str(tmp_path), "a b").count() == 4
    report = audit_dataset(frame(spark, clean()), CONFIG, as_of=AS_OF)
    write_json(report, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["total_checks"] == 19
    assert {c.category for c in filter_checks(report, categories=["temporal"])} == {"temporal"}


def test_remote_tables_and_keys(spark, tmp_path, monkeypatch):
    def fetch(url, key, timeout):
        if "gone" in url:
            raise OSError(url)
        return b"Date,Value\n2024-01-02,1\n" if url.endswith(".csv") else b'{"name": "n"}'

    remote = RemoteTables("http://example.invalid/datasets", "k", fetch)
    assert remote.read(spark, "7").frame.count() == 1 and remote.read(spark, "gone") is None and remote.valid_key()
    store = KeyStore("TIDEMARK_TEST_KEY", tmp_path / "key")
    assert store.load_with_source() == (None, None)
    store.save("abc")
    assert store.load_with_source() == ("abc", "file")
    monkeypatch.setenv("TIDEMARK_TEST_KEY", "env")
    assert store.load() == "env"
    store.delete()


def test_stream_is_audited_by_batch(spark, tmp_path):
    from tidemark.streaming.incremental import audit_stream

    frame(spark, clean()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Date string, Region string, Value double").parquet(str(tmp_path / "in"))
    audit_stream(stream, CONFIG, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 19


def test_the_table_is_read_once(spark):
    """And once more only where rows repeat."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for extra, times in ([], 1), ([("2024-01-10", "N", 101.0)] * 2, 2):
        rows = [*clean(), *extra]
        before = read.value
        source = frame(spark, rows).mapInArrow(count, "Date string, Region string, Value double")
        audit_dataset(source, CONFIG, frame(spark, clean()), AS_OF)
        assert read.value - before == times * len(rows)


def test_scratch_tables_go_with_the_report(spark, tmp_path):
    from tidemark import shared

    folder = shared.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    audit_dataset(frame(spark, clean()), CONFIG, as_of=AS_OF)
    assert set(os.listdir(folder)) <= before


@pytest.mark.parametrize("n", [49, 50, 51, 999, 1000, 1001])
def test_limits_of_distinct_values_are_exact(spark, n):
    rows = [(i, f"v{i % n}", i if i else 1) for i in range(1500)]
    table = spark.createDataFrame(rows, "row_id long, t string, code long")
    facts = autodetect.column_facts(table)
    assert facts["t"]["distinct"] == n
    assert autodetect.is_id_column("row_id", facts["row_id"]) and not autodetect.is_id_column("code", facts["code"])
    assert autodetect.classify_columns(table)["t"] == ("dimension" if n <= 50 else "ignore")
    found = auto_detect_config(table, "x")
    assert ("t" in found["dimension_columns"]) == (n <= 1000)
    assert found["expected_dimensions"].get("t") == (sorted(f"v{i}" for i in range(n)) if n <= 50 else None)


@pytest.mark.parametrize("nulls, limit", [(4, 0.02), (5, 0.03), (25, 0.07), (26, 0.10)])
def test_null_limits_hold_at_their_bounds(spark, nulls, limit):
    table = spark.createDataFrame([(float(i) if i >= nulls else None,) for i in range(500)], "v double")
    assert auto_detect_config(table, "x")["max_null_pct"] == limit


def test_labels_say_what_columns_hold(spark):
    rows = [("2024-01-01", "a", 1, dt.date(2024, 1, 1), f"t{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "d string, c string, n int, day date, t string")
    assert autodetect.type_labels(table) == {"d": "date (text)", "c": "category (1 values)", "n": "number", "day": "date", "t": "text (60 values)"}
    assert autodetect.type_labels(table.limit(0))["c"] == "category (0 values)"
