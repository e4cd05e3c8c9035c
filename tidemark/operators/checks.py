"""The nineteen checks of an audit, each as a small lazy frame of facts.

Every ``*_facts`` function returns a DataFrame of aggregates; ``audit.py`` turns
facts into results. Facts that scan the whole table share one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendars
from tidemark.shared import fresh, written

Z_MIN_VALUES = 10


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def missing(c: Column, kind: str) -> Column:
    return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()


# Integrity: one pass over the table.


def table_aggregates(df: DataFrame, value: str, date: str | None, bounds: dict | None = None) -> list[Column]:
    """Counts, nulls, zeros, range and distribution of one value column, and the
    date span, as columns of a single aggregation."""
    kinds = dict(df.dtypes)
    v = q(value).cast("double")
    bounds = bounds or {}
    out = [F.count("*").alias("n_rows")]
    out += [F.count_if(missing(q(c), k)).alias(f"null:{c}") for c, k in kinds.items()]
    out += [
        F.count_if(v == 0).alias("zeros"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("skew_pop"),
        F.count_if(v < F.lit(bounds.get("min"))).alias("below"),
        F.count_if(v > F.lit(bounds.get("max"))).alias("above"),
    ]
    if date:
        out += [F.min(q(date)).alias("first_date"), F.max(q(date)).alias("last_date")]
    return out


def corrected_skew(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness, null under three values or without spread."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def row_hashes(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """128 bits of the given columns of a row, as two longs."""
    kinds = dict(df.dtypes)
    # zero has two signs that are equal; a null and its place count too
    parts = [q(c) + 0.0 if kinds[c] in ("double", "float") else q(c) for c in columns]
    nulls = F.concat(*[F.when(q(c).isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit("row"), *reversed(parts), nulls)


#: Hashes of repeated rows that are broadcast: 16 bytes each.
BROADCAST_HASHES = 1_000_000


def repeated_hashes(hashed: DataFrame) -> DataFrame:
    """(h1, h2) that more than one row has."""
    return hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")


def exact_duplicates(df: DataFrame, columns: list[str] | None = None, again: DataFrame | None = None) -> DataFrame:
    """I3: rows beyond the first of each set of equal ones.

    Rows are grouped by a 128-bit hash of 16 bytes, so whole rows don't travel;
    only those whose hash comes again are compared column by column, summed up
    where they are read before they travel. ``again`` are these hashes, if known."""
    given = columns or df.columns
    h1, h2 = row_hashes(df, given)
    hashed = df.select(*[q(c).alias(f"v{i}") for i, c in enumerate(given)], h1.alias("h1"), h2.alias("h2"))  # no name clashes with ours
    names = [c for c in hashed.columns if c[0] == "v"]
    again = repeated_hashes(hashed) if again is None else again
    few = again.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    some = hashed.join(F.broadcast(again) if few else again, ["h1", "h2"], "left_semi")
    same = some.groupBy("h1", "h2", *names).agg(F.count("*").alias("n"))
    return same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("exact_duplicate_count"))


def null_percentages(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """I1: (column, nulls, pct) of every column, from one aggregation."""
    kinds = dict(df.dtypes)
    names = columns or df.columns
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(missing(q(c), kinds[c])).alias(f"c{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(names)])
    return counts.select("n", F.inline(rows)).select("column", "nulls", (F.col("nulls") / F.col("n")).alias("pct"))


# Schema.


def dimension_diff(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """S3: (value, status) of new and missing values of a dimension."""
    actual = df.where(q(column).isNotNull()).select(q(column).cast("string").alias("value")).distinct()
    rows = F.array(*[F.lit(str(x)) for x in expected]) if expected else F.array().cast("array<string>")
    wanted = df.sparkSession.range(1).select(F.explode(rows).alias("value")).distinct()
    new = actual.join(wanted, "value", "left_anti").withColumn("status", F.lit("new"))
    return new.unionByName(wanted.join(actual, "value", "left_anti").withColumn("status", F.lit("missing")))


# Temporal: all on the distinct dates.


def date_index(df: DataFrame, date: str) -> DataFrame:
    """Distinct midnight dates."""
    return df.where(q(date).isNotNull()).select(q(date).cast("date").alias("day")).distinct()


def frequency_facts(days: DataFrame) -> DataFrame:
    """T1: median gap, weekend flag, count and inferred frequency of dates."""
    gaps = days.select("day", F.datediff("day", F.lag("day").over(W.orderBy("day"))).alias("gap"))
    facts = gaps.agg(
        F.count("*").alias("n_dates"), F.median("gap").alias("median_gap"),
        F.coalesce(F.bool_or(calendars.is_weekend(F.col("day"))), F.lit(False)).alias("weekends"),
    )
    gap = F.col("median_gap")
    inferred = (
        F.when(gap <= 1.5, F.when(F.col("weekends"), "D").otherwise("B"))
        .when(gap <= 5, "B").when(gap <= 10, "W").when(gap <= 40, "M").when(gap <= 100, "Q").when(gap.isNotNull(), "A")
    )
    return facts.withColumn("inferred", inferred)


def gaps(days: DataFrame, frequency: str, country: str | None = None) -> DataFrame:
    """T2: expected days that are not there."""
    bounds = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return calendars.calendar(bounds, "a", "b", frequency, country).join(days, "day", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """T3: keys of more than one row, with their number of rows; nulls are equal."""
    return df.groupBy(*map(q, keys)).agg(F.count("*").alias("rows")).where("rows > 1")


def weekday_histogram(days: DataFrame) -> DataFrame:
    """T6: dates by weekday, Monday is 0."""
    return days.groupBy(F.weekday("day").alias("weekday")).agg(F.count("*").alias("n"))


# Statistics.


def zscores(df: DataFrame, value: str, dims: list[str]) -> DataFrame:
    """A1: rows with ``z``. With dimensions, by group with the sample deviation,
    without rows of null dimensions; without, by the population deviation.

    The groups' moments are aggregated and joined back, so no group's rows meet
    in one task."""
    v = q(value).cast("double")
    if not dims:
        moments = df.agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
        joined = df.crossJoin(F.broadcast(moments))  # one row
    else:
        known = df.dropna(subset=dims)
        moments = known.groupBy(*map(q, dims)).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"))
        joined = known.join(moments, dims)
    z = F.when(F.col("_std") > 0, (v - F.col("_mean")) / F.col("_std"))
    return joined.withColumn("z", z).drop("_mean", "_std")


def in_ranges(df: DataFrame, dims: list[str], date: str, order: str, name: str, keep: Callable = written) -> DataFrame:
    """``df`` as a written table whose rows are dealt into even ranges of
    (dimensions, date, order); ``name`` is the column that numbers the ranges.

    A range is bounded by the rows, not by a group or a month: one group of one
    day is spread over as many ranges as it has rows for."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *map(q, dims), q(date).asc_nulls_last(), q(order))
    return keep(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def pct_changes(
    df: DataFrame, value: str, dims: list[str], date: str, order: str, fill_nulls: bool = True, ranges: str | None = None, keep: Callable = written
) -> DataFrame:
    """A2: rows with ``change``, the absolute change from the row before.

    Missing values take the last one's first (unless ``fill_nulls`` is off); a
    change from zero is infinite, from zero to zero null. Rows without a date come
    last; rows with a null dimension go.

    Rows are in order within ranges (``in_ranges``, or the column ``ranges`` if
    ``df`` is dealt already), so no group has to fit one task. The last value of
    each range is carried on to those after it: a row for each group and range."""
    names, given = [], [*df.columns]
    for x in ("_value", "_last", "_carry", "_now", "_before", "_range"):
        names.append(fresh([*given, *names], x))
    v, last, carry, now, before, at = names
    known = df.dropna(subset=dims) if dims else df
    if ranges is None:
        known, ranges = in_ranges(known, dims, date, order, at, keep), at
    known = known.withColumn(v, q(value).cast("double"))
    groups = [*map(q, dims)]
    place = F.struct(q(date).isNull(), q(date), q(order))
    ends = F.max_by(v, F.when(F.col(v).isNotNull(), place) if fill_nulls else place)
    earlier = W.partitionBy(*groups).orderBy(ranges)
    carried = F.last(last, ignorenulls=True).over(earlier.rowsBetween(W.unboundedPreceding, -1)) if fill_nulls else F.lag(last).over(earlier)
    starts = known.groupBy(*groups, ranges).agg(ends.alias(last)).withColumn(carry, carried).drop(last)
    rows = known.join(starts, [*dims, ranges])
    w = W.partitionBy(*groups, ranges).orderBy(q(date).asc_nulls_last(), q(order))
    value_now = F.col(v)
    if fill_nulls:
        value_now = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), carry)
    rows = rows.withColumn(now, value_now)
    rows = rows.withColumn(before, F.when(F.row_number().over(w) == 1, F.col(carry)).otherwise(F.lag(now).over(w)))
    change = F.when((F.col(before) == 0) & (F.col(now) != 0), F.lit(float("inf"))).otherwise(F.abs(F.try_divide(now, before) - 1))
    return rows.select(*map(q, given), change.alias("change"))


# Consistency with a snapshot.


def key_index(df: DataFrame, date: str, dims: list[str], values: list[str], order: str) -> DataFrame:
    """Value columns by (date text, dimensions); of a repeated key the first row."""
    w = W.partitionBy("_date", *map(q, dims)).orderBy(q(order))
    rows = df.select(F.date_format(q(date), "yyyy-MM-dd").alias("_date"), *map(q, dims), *map(q, values), q(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", order)


def revision_facts(now: DataFrame, before: DataFrame, dims: list[str], values: list[str], cutoff: str | None = None) -> DataFrame:
    """C1 to C3 in one join: common keys, changed rows and cells, old changes."""
    a, b = now.alias("a"), before.alias("b")
    on = F.col("a._date").eqNullSafe(F.col("b._date"))
    for d in dims:
        on = on & F.col(f"a.`{d}`").eqNullSafe(F.col(f"b.`{d}`"))
    differ = [~F.col(f"a.`{v}`").eqNullSafe(F.col(f"b.`{v}`")) for v in values]
    changed = F.lit(False)
    for d in differ:
        changed = changed | d
    rows = a.join(b, on).select(
        F.col("a._date").alias("_date"), changed.alias("changed"), sum([d.cast("int") for d in differ], F.lit(0)).alias("cells")
    )
    return rows.agg(
        F.count("*").alias("common_rows"),
        F.count_if("changed").alias("changed_rows"),
        F.coalesce(F.sum("cells"), F.lit(0)).cast("long").alias("changed_cells"),
        (F.count("*") * len(values)).alias("total_cells"),
        F.count_if(F.col("changed") & (F.col("_date") < F.lit(cutoff))).alias("old_revisions"),
    )
