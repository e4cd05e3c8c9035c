"""Tiled correlations and the greedy matching in rounds, against plain forms."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.functions.names import series_name
from tidemark.operators import pairing, series

POINTS = "series_name string, date timestamp_ntz, value double"
DAY = dt.datetime(2024, 1, 1)


def frame(spark, held):
    rows = [(name, DAY + dt.timedelta(days=d), None if v is None else float(v)) for name, points in held.items() for d, v in points]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def plain_r(a, b, least=5):
    """r and overlap of two lists of (day, value), all pairs of equal days."""
    by = defaultdict(list)
    for d, v in b:
        if v is not None:
            by[d].append(v)
    pairs = [(x, y) for d, x in a if x is not None for y in by[d]]
    if len(pairs) < least:
        return None
    x, y = np.array(pairs).T
    if not np.isfinite(x).all() or not np.isfinite(y).all() or len({*x}) == 1 or len({*y}) == 1:
        return math.nan, len(pairs)
    return float(np.corrcoef(x, y)[0, 1]), len(pairs)


def series_of(seed, n, names):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        level = rnd.choice([0.0, 5.0, 1e9])
        days = sorted(rnd.sample(range(40), rnd.randint(3, 40)))
        points = [(d, level + math.sin(d / (1 + i % 7)) + rnd.gauss(0, 0.05 + i % 3)) for d in days]
        out[names(i)] = points
    out[names(n)] = [(d, 0.1) for d in range(30)]  # constant
    out[names(n + 1)] = [(d, 7.5 if d < 20 else d) for d in range(40)]  # constant over some dates
    out[names(n + 2)] = [(d, math.inf if d == 3 else d) for d in range(30)]
    out[names(n + 3)] = [(d % 10, d * 1.5) for d in range(35)] + [(50, None)]  # dates that repeat
    out[names(n + 4)] = [(d, 7.5) for d in range(0, 22)] + [(60, 1.0)]
    return out


@pytest.mark.parametrize("cells", [pairing.TILE_CELLS, 90])
def test_tiles_give_the_correlation_of_every_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(pairing, "TILE_CELLS", cells)
    a, b = series_of(1, 12, lambda i: f"s{i}"), series_of(2, 9, lambda i: f"p{i}")
    got = {(r["source"], r["platform"]): (r["r"], r["overlap"]) for r in series.correlations(frame(spark, a), frame(spark, b)).collect()}
    want = {(s, p): x for s in a for p in b if (x := plain_r(a[s], b[p]))}
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n
        assert got[k][0] is None if math.isnan(r) else got[k][0] == pytest.approx(r, abs=1e-7), k
    strong = {(r["source"], r["platform"]) for r in series.correlations(frame(spark, a), frame(spark, b), least=0.3).collect()}
    assert strong == {k for k, (r, _) in got.items() if r is not None and r >= 0.3}


def test_no_join_on_dates(spark):
    a = frame(spark, {"a": [(d, float(d)) for d in range(9)]})
    plan = series.correlations(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_series_without_a_common_date(spark):
    a, b = frame(spark, {"a": [(d, 1.0 * d) for d in range(9)]}), frame(spark, {"b": [(d + 20, 1.0 * d) for d in range(9)]})
    assert series.correlations(a, b).count() == 0
    assert series.correlations(a, a.limit(0)).count() == 0 and series.correlations(a.limit(0), a.limit(0)).count() == 0


def boost_of(s, p):
    a, b, na, nb = s.strip().lower(), p.strip().lower(), series_name(s), series_name(p)
    return 0.010 if a == b else 0.005 if na == nb else 0.002 if na and nb and (na in nb or nb in na) else 0.0


def plain_greedy(strong, close):
    """One platform after the other, best open r first."""
    taken, done, out = set(), set(), {}
    for s, p, r in sorted(strong, key=lambda x: (-x[2], x[1])):
        if p in done or s in taken:
            continue
        near = [(x, y) for x, q, y in strong if q == p and x not in taken and y >= r - close]
        out[p] = max(near, key=lambda x: (x[1] + boost_of(x[0], p), x[1], x[0]))[0], len(near), r
        taken.add(out[p][0])
        done.add(p)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_greedy_choice(spark, seed):
    rnd = random.Random(seed)
    words = ["GDP", "gdp", "cpi-core", "CPI core", "rate", "x", "Rate A", "-", "y z", "other", "w"]
    sources, platforms = rnd.sample(words, 9), rnd.sample(words, 9)
    steps = [1.0, 0.99, 0.985, 0.97, 0.95, 0.9] if seed % 2 else [0.85 + rnd.random() * 0.15 for _ in range(50)]
    strong = [(s, p, rnd.choice(steps)) for s in sources for p in platforms if rnd.random() < 0.6]
    got = pairing.greedy_pairs(spark.createDataFrame(strong, "source string, platform string, r double"), 0.02).collect()
    assert {r["platform"]: (r["source"], r["near"], r["best"]) for r in got} == plain_greedy(strong, 0.02)


def test_a_long_chain_of_platforms_is_settled(spark):
    strong = [x for i in range(6) for x in ((f"s{i}", f"p{i}", 0.9 + i / 100), (f"s{i}", f"p{i + 1}", 0.905 + i / 100))]
    got = pairing.greedy_pairs(spark.createDataFrame(strong, "source string, platform string, r double"), 0.02).collect()
    assert {r["platform"]: (r["source"], r["near"], r["best"]) for r in got} == plain_greedy(strong, 0.02)
