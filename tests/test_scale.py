"""Forms of operators that hold for any size, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, compare, quantiles

random.seed(5)
COLUMNS = {
    "few values": [random.randint(0, 9) for _ in range(3000)],
    "hot values": [1.0] * 2000 + [2.0] * 5 + [5.0] * 2000,
    "heavy tail": [-(random.random() ** 9) * 1e9 for _ in range(2000)],
    "half infinite": [0.0] * 500 + [float("inf")] * 500,
    "both infinities": [float("-inf")] * 300 + [-1.0, 2.0] + [float("inf")] * 300,
    "two values far apart": [1e-300] * 700 + [1e300] * 700,
    "one": [3.0],
    "none": [],
}


def percentile(values, share):
    values, at = sorted(values), share * (len(values) - 1)
    a, b, part = values[int(at)], values[-int(-at // 1)], at - int(at)
    return a if a == b else (1 - part) * a + part * b


@pytest.mark.parametrize("name", COLUMNS)
def test_percentiles_narrow_to_the_exact_ones(spark, monkeypatch, name):
    monkeypatch.setattr(quantiles, "FEW_ROWS", 50)
    monkeypatch.setattr(quantiles, "STEPS", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    values, shares = COLUMNS[name], [0.25, 0.5, 0.987]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = quantiles.exact_percentiles(frame, F.col("v"), shares)
    if values:
        assert got == pytest.approx([percentile(values, s) for s in shares], rel=1e-12)
    else:
        assert got == [None] * 3


def test_percentiles_of_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_ROWS", 100)
    monkeypatch.setattr(quantiles, "STEPS", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    groups = {(k if k != "one" else None, i % 2): v for i, (k, v) in enumerate(COLUMNS.items())}
    groups["small", 1] = [random.random() for _ in range(90)]
    rows = [(*g, float(v)) for g, values in groups.items() for v in values] + [("none", 0, None), ("small", 1, float("nan"))]
    frame = spark.createDataFrame(rows, "`x` string, k0 int, n double").repartition(5)
    for limit in (20_000, 2):  # brackets broadcast or shuffled
        monkeypatch.setattr(quantiles, "FEW_BRACKETS", limit)
        found = quantiles.grouped_percentiles(frame, ["x", "k0"], F.col("n"), [0.0, 0.37, 1.0]).collect()
        got = {(r["x"], r["k0"]): [r["p0"], r["p1"], r["p2"]] for r in found}
        assert got.keys() == {g for g, values in groups.items() if values}
        for g, p in got.items():
            assert p == pytest.approx([percentile(groups[g], s) for s in (0.0, 0.37, 1.0)], rel=1e-12), g


def test_repeated_rows_are_told_apart_by_their_columns(spark):
    nan = float("nan")
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("x", "y", None), ("x", "y", None), ("x", "y", nan), ("x", "y", nan)]
    frame = spark.createDataFrame(rows, "n string, h1 string, `v.0` double")
    assert checks.exact_duplicates(frame).first()[0] == 3
    assert checks.exact_duplicates(frame.limit(0)).first()[0] == 0


@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("dims", [[], ["g"]])
def test_changes_cross_months(spark, fill, dims):
    """Gaps of months, nulls at their edges and rows without a date."""
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        day = None if i % 50 == 49 else f"2024-{rnd.choice([1, 2, 5, 6, 12]):02d}-{rnd.randint(1, 28):02d}"
        rows.append((day, rnd.choice("ab"), rnd.choice([None, None, 0.0, 1.0, 2.0, 4.0]), i))
    frame = spark.createDataFrame(rows, "d string, g string, v double, i long").withColumn("d", F.to_date("d"))
    got = {r["i"]: r["change"] for r in checks.pct_changes(frame, "v", dims, "d", "i", fill).collect()}
    last: dict = {}
    for d, g, v, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[3])):
        key = g if dims else ""
        before = last.get(key)
        now = before if v is None and fill else v
        last[key] = now
        if before is None or now is None:
            expected = None
        elif before == 0:
            expected = float("inf") if now else None
        else:
            expected = abs(now / before - 1)
        assert got[i] == expected, (i, d, g, v)


def test_one_dense_month_spreads_over_ranges(spark):
    rows = [("2024-01-05", "a", float(i % 97), i) for i in range(4000)]
    table = spark.createDataFrame(rows, "d string, _value string, v double, i long").withColumn("d", F.to_date("d"))
    ranged = checks.in_ranges(table, ["_value"], "d", "i", "r")
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * len(rows) / 4
    got = {r["i"]: (r["change"], r["_value"]) for r in checks.pct_changes(table, "v", ["_value"], "d", "i").collect()}
    for i in range(1, 4000):
        a, b = float((i - 1) % 97), float(i % 97)
        assert got[i] == (float("inf") if a == 0 else abs(b / a - 1), "a")


def plain_shift(source, platform, tolerance):
    out = {}
    for s in (-1, 0, 1):
        hits = [
            p is not None and v is not None and (abs(p - v) <= tolerance * max(abs(v), 1e-10) or abs(p - v) <= tolerance)
            for d, k, v in source for e, q, p in platform if q == k and e + s == d
        ]
        if hits:
            out[s] = sum(hits) / len(hits)
    return out


def test_shifts_look_over_the_edges_of_windows(spark):
    rnd = random.Random(8)
    day0 = 19_700  # days since 1970; windows of 64 days end in between

    def rows(n, keys):
        return [(day0 + rnd.randint(0, 200), rnd.choice(keys), rnd.choice([1.0, 2.0, 2.01, None])) for _ in range(n)]

    source, platform = rows(300, "aab"), rows(300, "aabc")
    frames = [
        spark.createDataFrame(x, "day int, Key string, Value double").selectExpr("timestamp_seconds(day * 86400L)::timestamp_ntz AS Date", "Key", "Value")
        for x in (source, platform)
    ]
    got = {r["shift"]: r["match_pct"] for r in compare.shift_matches(*frames, 0.01).collect()}
    assert got == pytest.approx(plain_shift(source, platform, 0.01))
    assert compare.shift_matches(frames[0], frames[1].limit(0), 0.01).count() == 0


def test_percentiles_of_counted_values_over_ranges(spark):
    """Places at the ends of ranges, repeated values, null groups, infinities."""
    rnd = random.Random(5)
    inf, nan = float("inf"), float("nan")
    groups = {
        None: [rnd.random() for _ in range(701)], "a": [float(rnd.randint(0, 3)) for _ in range(900)], "b": [-inf, 1.0, inf],
        "c": [7.0], "d": [float(i) for i in range(1000)],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [("e", None), ("a", nan), ("d", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    shares = [0.0, 0.25, 0.37, 0.5, 0.999, 1.0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = quantiles.counted_percentiles(frame, ["g"], F.col("v"), shares).collect()
        whole = quantiles.counted_percentiles(frame.where("g = 'd'"), [], F.col("v"), shares).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(groups)
    for r in found:
        expected = [percentile(groups[r["g"]], s) for s in shares]
        assert [r[f"p{i}"] for i in range(6)] == pytest.approx(expected, rel=1e-12, nan_ok=True), r["g"]
    assert list(whole) == pytest.approx([percentile(groups["d"], s) for s in shares], rel=1e-12)
    assert quantiles.counted_percentiles(frame.where("g = 'e'"), ["g"], F.col("v"), shares).count() == 0
