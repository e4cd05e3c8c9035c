"""Snapshots, remote tables, sheets, the order of rows over files, the CLI."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import canonical, shape
from tidemark.sources import readers, snapshots
from tidemark.sources.remote import RemoteTables

BODIES = {"a": b"Date,v\n2024-01-01,1\n2024-01-02,\n", "b": b"v,Date,extra\n2.5,2024-02-01,x\n", "c": b"Date\n2024-03-01\n"}


def service(bodies):
    def fetch(url, key, timeout):
        assert key == "k"
        name = url.rsplit("/", 1)[-1]
        if name.endswith(".csv") and name[:-4] in bodies:
            return bodies[name[:-4]]
        if name in bodies or name == "datasets":
            return json.dumps({"name": f"Table {name}"}).encode()
        raise OSError(f"no {name}")

    return fetch


def test_datasets_are_read_by_tasks_of_their_own(spark):
    remote = RemoteTables("http://example.invalid/datasets/", "k", service(BODIES))
    rows = remote.frame(spark, ["a", "b", "c"], "dataset_id string, Date date, v double")
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r["dataset_id"], str(r["Date"]), r["v"]) for r in rows.collect())
    assert got == [("a", "2024-01-01", 1.0), ("a", "2024-01-02", None), ("b", "2024-02-01", 2.5), ("c", "2024-03-01", None)]
    one = remote.read(spark, "a")
    assert one.name == "Table a" and one.frame.columns == ["Date", "v"] and one.frame.count() == 2
    assert remote.read(spark, "gone") is None


def failing(monkeypatch, step):
    def stop(*args):
        raise RuntimeError(step)

    monkeypatch.setattr(*step, stop)


STEPS = [(snapshots, "_write_version"), (snapshots._Folder, "replace"), (snapshots, "_clean")]


@pytest.mark.parametrize("step", range(len(STEPS)))
def test_a_failure_at_any_step_leaves_a_whole_snapshot(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    snapshots.save_snapshot(spark.range(3).coalesce(1), root, "x/y")
    with monkeypatch.context() as m:
        failing(m, STEPS[step])
        with pytest.raises(RuntimeError):
            snapshots.save_snapshot(spark.range(5).coalesce(1), root, "x/y")
    assert snapshots.load_snapshot(spark, root, "x/y").count() == (5 if STEPS[step][1] == "_clean" else 3)
    old = snapshots.load_snapshot(spark, root, "x/y")
    snapshots.save_snapshot(old.unionAll(old), root, "x/y")
    assert old.count() in (3, 5)  # a plan over the version before still reads it
    snapshots.save_snapshot(spark.range(1).coalesce(1), root, "x/y")
    assert snapshots.load_snapshot(spark, root, "x/y").count() == 1
    kept = [p.name for p in (tmp_path / "x_y.parquet").iterdir() if snapshots.VERSION.fullmatch(p.name)]
    assert len(kept) == 2 and snapshots.current_version(spark, root, "x/y").rsplit("/", 1)[-1] in kept


def test_a_bad_pointer_is_no_snapshot(spark, tmp_path):
    folder = tmp_path / "x.parquet"
    folder.mkdir()
    assert snapshots.load_snapshot(spark, str(tmp_path), "x") is None
    (folder / "CURRENT").write_text("../elsewhere")
    assert snapshots.load_snapshot(spark, str(tmp_path), "x") is None


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Files of unlike sizes, names against their order of writing, cut into splits."""
    folder = tmp_path_factory.mktemp("files")
    at, sizes = 0, {"b": 700, "a": 40, "c": 1, "d": 2000, "e": 0}
    want = []
    for name in sorted(sizes):
        rows = list(range(at, at + sizes[name]))
        at += sizes[name]
        want += rows
        (folder / f"{name}.csv").write_text("n\n" + "".join(f"{i}\n" for i in rows))
    return str(folder), want


def test_places_of_rows_over_files_and_splits(spark, many_files):
    folder, want = many_files
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.with_ordinals(spark.read.csv(folder, header=True, schema="n int"), "place").collect()
            assert sorted((r["place"], r["n"]) for r in got) == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["o"] for r in readers.with_ordinals(spark.range(10, numPartitions=3), "o").orderBy("id").collect()] == list(range(10))
    assert readers.with_ordinals(spark.range(0), "o").count() == 0
    shuffled = spark.read.csv(folder, header=True, schema="n int").groupBy("n").count().where("n % 3 = 0")
    assert sorted(r["o"] for r in readers.with_ordinals(shuffled, "o").collect()) == list(range(len(want[::3])))
    assert readers.with_order(shuffled, "o").count() == len(want[::3])
    kept = readers.with_order(spark.read.csv(folder, header=True, schema="n int").where("n % 2 = 0"), "o")
    assert [r["n"] for r in kept.orderBy("o").collect()] == want[::2]


def test_a_footer_goes_by_the_place_of_rows(spark, many_files):
    frame = readers.with_ordinals(spark.read.csv(many_files[0], header=True, schema="n int"), "o")
    kept = shape.drop_footer(frame, 5, "o", dense=True)
    assert kept.agg(F.max("n")).first()[0] == len(many_files[1]) - 6 and kept.count() == len(many_files[1]) - 5
    assert "Sort" not in kept._jdf.queryExecution().optimizedPlan().toString().replace("SortMerge", "").split("Window")[0]
    assert shape.drop_footer(frame.limit(0), 5, "o", dense=True).count() == 0
    rows = [(f"2024-01-{i:02}", "a", float(i)) for i in range(1, 11)] + [("total", "b", 55.0), ("2024-01-30", "note", 0.0)]
    table = spark.createDataFrame(rows, "Date string, Key string, Value double").coalesce(1)
    side = {"date_column": "Date", "key_columns": ["Key"], "value_column": "Value", "skip_rows_bottom": 2, "date_format": "iso"}
    assert canonical.canonicalize(table, side).df.count() == 10


def test_sheets_are_parsed_by_tasks(spark, tmp_path):
    def parse(content, sheet):
        import pandas as pd

        book = json.loads(content)
        return pd.DataFrame(book[sheet] if isinstance(sheet, str) else list(book.values())[sheet])

    book = {"one": {"n": [1, 2], "t": ["a", "b"]}, "two": {"t": ["c"], "n": [3], "more": [0]}}
    (tmp_path / "book.bin").write_text(json.dumps(book))
    got = readers.read_sheets(spark, str(tmp_path / "book.bin"), ["one", "two"], parse=parse)
    assert sorted(map(tuple, got.collect())) == [("one", 1, "a"), ("one", 2, "b"), ("two", 3, "c")]
    typed = readers.read_sheets(spark, str(tmp_path / "book.bin"), [1], "n double", parse=parse).collect()
    assert [tuple(r) for r in typed] == [("1", 3.0)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "d.csv").write_text("Date,Region,Value\n" + "".join(f"2024-01-{d:02},a,{d}\n" for d in range(1, 29)))
    (tmp_path / "c.json").write_text(json.dumps({"dataset_name": "d", "date_column": "Date", "dimension_columns": ["Region"], "value_column": "Value", "format": "long", "expected_frequency": "D", "acceptable_lag_days": 100000}))
    args = ["--data", str(tmp_path / "d.csv"), "--snapshots", str(tmp_path / "s"), "--reports", str(tmp_path / "r")]
    first = cli.main([*args, "--config", str(tmp_path / "c.json")])
    assert first in (0, 1, 2) and (tmp_path / "r" / "d.json").exists() and "checks" in capsys.readouterr().out
    report = json.loads((tmp_path / "r" / "d.json").read_text())
    assert {c["check_id"] for c in report["checks"]} >= {"S1", "T1", "I1", "A1", "C1"}
    assert snapshots.load_snapshot(spark, str(tmp_path / "s"), "d").count() == 28
    (tmp_path / "d.csv").write_text("Date,Region,Value\n" + "".join(f"2024-01-{d:02},a,{d * 2}\n" for d in range(1, 29)))
    cli.main([*args, "--config", str(tmp_path / "c.json")])
    again = {c["check_id"]: c for c in json.loads((tmp_path / "r" / "d.json").read_text())["checks"]}
    assert again["C1"]["details"]["changed_rows"] == 28
    assert cli.main(["--data", str(tmp_path / "none.csv"), "--no-snapshot"]) == 1
    assert cli.main([*args[:2], "--no-snapshot", *args[4:]]) in (0, 1, 2)  # an inferred config
