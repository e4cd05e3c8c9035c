"""Correlations of all pairs of series, and the greedy choice among them.

Series are packed into rows and dealt into blocks; every pair of blocks is a
tile. A tile puts its series on their common dates and gets all its pairs from
six matrix products, so points of different series are never joined row by row.

The greedy choice takes platforms by their best open correlation. A platform can
be settled as soon as no platform before it could take one of the sources that it
chooses from; all such platforms are settled together, round by round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import series_name_column
from tidemark.shared import scratch_tables, written

#: Cells (series times dates) of one side of a tile; a longer series is alone.
TILE_CELLS = 1 << 20
#: Series of one side of a tile, at most.
TILE_SERIES = 1024
#: A variance below this share of the squares is looked at again, exactly.
DOUBTFUL = 1e-6

PAIRS = "source string, platform string, r double, overlap long"


def _packed(points: DataFrame) -> DataFrame:
    """(name, t, n, mean, m2): a row of each series, with its dates and the
    number, mean and squared deviations of its points at each. Points of one date
    are summed up first, so a row is as long as the series has dates."""
    known = points.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("date").isNotNull() & F.col("series_name").isNotNull())
    at = known.groupBy("series_name", F.unix_micros(F.col("date").cast("timestamp")).alias("t")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
    )
    one = F.col("lo") == F.col("hi")  # equal values stay as they are
    moments = F.struct(
        "t",
        F.col("n").cast("double").alias("n"),
        F.when(one, F.col("lo")).otherwise(F.col("mean")).alias("mean"),
        F.when(one, 0.0).otherwise(F.col("var") * F.col("n")).alias("m2"),
    )
    rows = at.groupBy("series_name").agg(F.collect_list(moments).alias("at"))
    return rows.select(F.col("series_name").alias("name"), *[F.col(f"at.{x}").alias(x) for x in ("t", "n", "mean", "m2")])


class _Side:
    """The series of one side of a tile on the dates that both sides have."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.names = table["name"].combine_chunks()
        lists = {c: table[c].combine_chunks() for c in ("t", "n", "mean", "m2")}
        self.series = np.repeat(np.arange(len(self.names)), np.diff(lists["t"].offsets.to_numpy()))
        self.t, self.n, self.mean, self.m2 = (x.flatten().to_numpy() for x in lists.values())

    def put(self, dates: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(dates, self.t), len(dates) - 1)
        held = dates[at] == self.t
        series, at = self.series[held], at[held]
        n, mean, m2 = self.n[held], self.mean[held], self.m2[held]
        odd = ~np.isfinite(mean)
        base = np.full(len(self.names), np.inf)
        np.minimum.at(base, series[~odd], mean[~odd])
        mean, m2 = np.where(odd, 0.0, mean - base[series]), np.where(odd, 0.0, m2)
        self.N, self.X, self.Q, self.M, self.odd = (np.zeros((len(self.names), len(dates))) for _ in range(5))
        for matrix, x in ((self.N, n), (self.M, mean), (self.X, n * mean), (self.Q, m2 + n * mean * mean), (self.odd, odd)):
            matrix[series, at] = x


def _exactly(a: _Side, b: _Side, i: int, j: int) -> float | None:
    """r of one pair from deviations of the means over its own dates."""
    on = (a.N[i] > 0) & (b.N[j] > 0)
    na, nb = a.N[i, on], b.N[j, on]
    parts = []
    for side, k, mine, other in ((a, i, na, nb), (b, j, nb, na)):
        m = side.M[k, on]
        spread = side.Q[k, on] - mine * m * m  # of points of one date
        if m.min() == m.max() and np.all(np.abs(spread) <= DOUBTFUL * side.Q[k, on]):
            return None
        gap = m - np.average(m, weights=na * nb)
        parts.append((gap, float((other * (spread + mine * gap * gap)).sum())))
    (x, vx), (y, vy) = parts
    return float((na * nb * x * y).sum() / np.sqrt(vx * vy)) if vx > 0 and vy > 0 else None


def _tile(source: pa.Table, platform: pa.Table, min_overlap: int, least: float | None) -> pa.Table:
    none = pa.table({"source": pa.array([], pa.string()), "platform": pa.array([], pa.string()), "r": pa.array([], pa.float64()), "overlap": pa.array([], pa.int64())})
    if not source.num_rows or not platform.num_rows:
        return none
    a, b = _Side(source), _Side(platform)
    dates = np.intersect1d(a.t, b.t)
    if not len(dates):
        return none
    a.put(dates)
    b.put(dates)
    n = a.N @ b.N.T
    sx, sy, sxy, sxx, syy = a.X @ b.N.T, a.N @ b.X.T, a.X @ b.X.T, a.Q @ b.N.T, a.N @ b.Q.T
    odd = (a.odd @ (b.N > 0).T + (a.N > 0) @ b.odd.T) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    kept = (n >= min_overlap) & (n > 0)
    r[odd | (sxx == 0) | (syy == 0)] = np.nan  # infinite or constant
    doubtful = kept & ~odd & (sxx > 0) & (syy > 0) & ((vx < DOUBTFUL * sxx) | (vy < DOUBTFUL * syy))
    for i, j in zip(*np.nonzero(doubtful), strict=True):
        exact = _exactly(a, b, i, j)
        r[i, j] = np.nan if exact is None else exact
    if least is not None:
        with np.errstate(invalid="ignore"):
            kept &= r >= least
    i, j = np.nonzero(kept)
    found = r[i, j]
    columns = [a.names.take(pa.array(i)), b.names.take(pa.array(j)), pa.array(found, mask=np.isnan(found)), pa.array(n[i, j].astype(np.int64))]
    return pa.Table.from_arrays(columns, ["source", "platform", "r", "overlap"])


def correlations(source: DataFrame, platform: DataFrame, min_overlap: int = 5, least: float | None = None) -> DataFrame:
    """(source, platform, r, overlap) of all pairs of series that have
    ``min_overlap`` pairs of points at equal dates; with ``least``, of those whose
    r reaches it. Frames have series_name, date and value.

    r is null where a series is constant or infinite over the common dates. Points
    without a value, a date or a name don't count. A series meets each block of the
    other side once; a task holds the series of two blocks."""
    facts = [x.agg(F.approx_count_distinct("series_name").alias("n"), F.approx_count_distinct("date").alias("dates")).first() for x in (source, platform)]
    size = min(TILE_SERIES, max(1, TILE_CELLS // max(1, *(f["dates"] for f in facts))))
    blocks = [-(-f["n"] // size) or 1 for f in facts]
    dealt = []
    for k, points in enumerate((source, platform)):
        mine = F.pmod(F.xxhash64("name"), F.lit(blocks[k])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - k] - 1)))
        rows = _packed(points).select("*", mine.alias("mine"), other.alias("other"))
        dealt.append(rows.withColumnsRenamed({"mine": "sp"[k] + "_block", "other": "ps"[k] + "_block"}))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tile(left, right, min_overlap, least)

    tiles = [x.groupBy("s_block", "p_block") for x in dealt]
    return tiles[0].cogroup(tiles[1]).applyInArrow(run, PAIRS)


def name_boost(source: Column, platform: Column) -> Column:
    """What a likeness of names adds to r: equal, equal in normal form, a part."""
    a, b = (F.lower(F.trim(x)) for x in (source, platform))
    na, nb = (series_name_column(x) for x in (source, platform))
    part = (na != "") & (nb != "") & (F.contains(nb, na) | F.contains(na, nb))
    return F.when(a == b, 0.010).when(na == nb, 0.005).when(part, 0.002).otherwise(0.0)


def greedy_pairs(strong: DataFrame, close: float) -> DataFrame:
    """(source, platform, r, boost, best, near): the greedy matching of pairs.

    The platform with the best open r comes first (equal ones by name). It takes,
    of its open sources within ``close`` of that, the one whose r and name boost
    are highest together (then by r, then the last name). ``near`` counts those
    sources, ``best`` is the platform's best open r. A round settles every platform
    that comes first for all sources it chooses from; the first open platform is
    one of them, so each round settles some. The result is a written table."""
    boost = name_boost(F.col("source"), F.col("platform"))
    with scratch_tables() as keep:
        open_ = keep(strong.select("source", "platform", "r", boost.alias("boost")), "open-pairs")
        settled = keep(open_.limit(0).withColumns({"best": F.lit(0.0), "near": F.lit(0).cast("long")}), "settled-pairs")
        while not open_.isEmpty():
            best = open_.groupBy("platform").agg(F.max("r").alias("best"))
            keyed = open_.join(best, "platform").withColumn("key", F.struct((-F.col("best")).alias("down"), F.col("platform").alias("name")))
            first = keyed.groupBy("source").agg(F.min("key").alias("first"))
            choice = F.max_by(F.struct("source", "r", "boost"), F.struct(F.col("r") + F.col("boost"), "r", "source"))
            sure = (
                keyed.where(F.col("r") >= F.col("best") - close)
                .join(first, "source")
                .groupBy("platform")
                .agg(F.bool_and(F.col("first") == F.col("key")).alias("sure"), choice.alias("pick"), F.count("*").alias("near"), F.first("best").alias("best"))
                .where("sure")
            )
            now = keep(sure.select("pick.source", "platform", "pick.r", "pick.boost", "best", "near"), "settled-pairs")
            open_ = keep(open_.join(now.select("platform"), "platform", "left_anti").join(now.select("source"), "source", "left_anti").select(*open_.columns), "open-pairs")
            settled = settled.unionByName(now)
        return written(settled, "matched-pairs")
