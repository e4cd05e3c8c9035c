"""Exact percentiles of columns and of groups of any size.

Groups of few values are counted value by value. For the others a sketch brackets
each wanted place of the order, for all groups together; counts say how many
values lie below, inside and on the ends of the bracket, and brackets narrow
until few values lie strictly inside. No task ever holds the values of a group.
Where few groups hold all of a table, its values are counted and dealt by ranges
instead, which reads the table once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.shared import scratch_tables, written

#: Values of a group, or of the inside of a bracket, that are counted one by one.
FEW_ROWS = 100_000
#: Sketched places of the order and the sketch's accuracy.
STEPS = 1000
ACCURACY = 10_000
#: Rounds after which a bracket is counted value by value in any case: each round
#: leaves about 2 / STEPS of what lies inside it.
MOST_ROUNDS = 6
#: Brackets up to this number are broadcast.
FEW_BRACKETS = 20_000


def grouped_percentiles(df: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """``keys`` and p0, p1, ...: the interpolated percentile of ``value`` at each
    share, for every group with a value.

    Nulls and NaN don't count; infinities are values like others; null keys are
    equal. Between two places the result is ``(1 - part) * lower + part * upper``.
    If some group has over FEW_ROWS values, the result is a written table of a row
    for each group; else it is a plan."""
    rows, names, wanted = _values(df, keys, value, shares)
    large = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("n") > FEW_ROWS)
    if large.isEmpty():
        return _few(rows, names, shares).select(*wanted)
    with scratch_tables() as keep:
        large = keep(large, "large-groups")
        many = _many(rows, large, names, shares, keep)
        few = _few(_meet(rows, large.select(*names), names, "left_anti"), names, shares)
        return written(few.unionByName(many).select(*wanted), "percentiles")


def counted_percentiles(df: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """``grouped_percentiles`` for few groups that hold all of a table; always a
    written table.

    Distinct values are counted and dealt by ranges of (group, value). The totals of
    the ranges tell which of them hold a wanted place; only these are summed up
    value by value. A value is one row there, so ranges are even."""
    rows, names, wanted = _values(df, keys, value, shares)
    with scratch_tables() as keep:
        held = rows.groupBy(*names, "x").agg(F.count("*").alias("c")).repartitionByRange(*names, "x")
        held = keep(held.withColumn("part", F.spark_partition_id()), "value-counts")
        mine = W.partitionBy(*names)
        parts = held.groupBy(*names, "part").agg(F.sum("c").alias("all")).withColumns({
            "_n": F.sum("all").over(mine),
            "before": F.sum("all").over(mine.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("all"),
        })
        asked = F.lit(False)
        for s in shares:
            for place in _place(s, F.col("_n"))[:2]:
                asked = asked | ((place >= F.col("before")) & (place < F.col("before") + F.col("all")))
        parts = keep(parts.where(asked).drop("all"), "ranges")
        running = W.partitionBy(*names, "part").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
        counted = _meet(held, parts, [*names, "part"]).withColumn("_up", F.col("before") + F.sum("c").over(running))
        found = _picked(counted, names, shares, [F.col("_up")] * len(shares), F.max("_n"))
        return written(found.select(*wanted), "percentiles")


def exact_percentiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """The interpolated percentile of a column at each share; nulls don't count."""
    row = grouped_percentiles(df, [], value, shares).first()
    return [None] * len(shares) if row is None else [row[f"p{i}"] for i in range(len(shares))]


def _values(df: DataFrame, keys: list[str], value: Column, shares: list[float]) -> tuple[DataFrame, list[str], list]:
    """Rows of groups (k0, k1, ...) and values (x), the groups' names, and the result's columns."""
    names = [f"k{i}" for i in range(len(keys))]
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], x.alias("x")).where("x is not null")
    return rows, names, [*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[f"p{i}" for i in range(len(shares))]]


def _meet(rows: DataFrame, groups: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a row of each group. Large groups are few beside the
    rows; up to FEW_BRACKETS they are broadcast, beyond that the shuffled join is
    split where a group is large."""
    few = groups.limit(FEW_BRACKETS + 1).count() <= FEW_BRACKETS
    right = groups.withColumnsRenamed({n: f"_{n}" for n in names})
    if not names:
        return rows.join(F.broadcast(right), how=how) if how != "inner" else rows.crossJoin(F.broadcast(right))  # one row
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return rows.join(F.broadcast(right) if few else right, on, how).drop(*[f"_{n}" for n in names])


def _place(share: float, n: Column) -> tuple[Column, Column, Column]:
    """The places before and after a share, and the part of the way between."""
    at = F.lit(share) * (n - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def _picked(counted: DataFrame, names: list[str], shares: list[float], under: list[Column], total: Column) -> DataFrame:
    """Percentiles from values with, for each share, the rows up to each value."""
    picks = [total.alias("n")]
    for i, s in enumerate(shares):
        for side, place in zip("ab", _place(s, F.col("_n")), strict=False):
            picks.append(F.min(F.when(under[i] > place, F.col("x"))).alias(f"{side}{i}"))
    found = counted.groupBy(*names).agg(*picks).where("n is not null")  # without keys, no rows give one
    out = []
    for i, s in enumerate(shares):
        a, b, part = F.col(f"a{i}"), F.col(f"b{i}"), _place(s, F.col("n"))[2]
        out.append(F.when(a == b, a).otherwise((1 - part) * a + part * b).alias(f"p{i}"))
    return found.select(*names, *out)


def _few(rows: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    """Groups of at most FEW_ROWS values."""
    held = rows.groupBy(*names, "x").agg(F.count("*").alias("c"))
    mine = W.partitionBy(*names)
    counted = held.withColumns({"_up": F.sum("c").over(mine.orderBy("x").rowsBetween(W.unboundedPreceding, 0)), "_n": F.sum("c").over(mine)})
    return _picked(counted, names, shares, [F.col("_up")] * len(shares), F.max("_n"))


def _inside(i: int, low: str = "lo", high: str = "hi") -> Column:
    return F.col("x").between(F.col(f"{low}{i}"), F.col(f"{high}{i}"))


def _strictly(a: Column, b: Column) -> Column:
    return F.count_if((F.col("x") > a) & (F.col("x") < b))


def _many(rows: DataFrame, large: DataFrame, names: list[str], shares: list[float], keep) -> DataFrame:
    """Large groups: a bracket (lo, hi) for each share, with the rows below it."""
    first = {}
    for i in range(len(shares)):
        first |= {f"lo{i}": F.col("lo"), f"hi{i}": F.col("hi"), f"below{i}": F.lit(0).cast("long"), f"in{i}": F.col("n")}
    state = keep(large.withColumns(first).drop("lo", "hi"), "brackets")
    for _ in range(MOST_ROUNDS):
        wide = F.lit(False)
        for i in range(len(shares)):
            wide = wide | ((F.col(f"in{i}") > FEW_ROWS) & (F.col(f"lo{i}") < F.col(f"hi{i}")))
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        state = keep(state.where(~wide).unionByName(_narrowed(rows, open_, names, shares).select(*state.columns)), "brackets")
    met = _meet(rows, state, names)
    some = F.lit(False)
    for i in range(len(shares)):
        some = some | _inside(i)
    facts = [c for c in state.columns if c not in names]
    held = met.where(some).groupBy(*names, "x", *facts).agg(F.count("*").alias("c"))
    running = W.partitionBy(*names).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    up = {f"_up{i}": F.col(f"below{i}") + F.sum(F.when(_inside(i), F.col("c")).otherwise(0)).over(running) for i in range(len(shares))}
    counted = held.withColumns(up | {"_n": F.col("n")})
    return _picked(counted, names, shares, [F.when(_inside(i), F.col(f"_up{i}")) for i in range(len(shares))], F.max("_n"))


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    steps = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    met = _meet(rows, state, names)
    sketches = []
    for i in range(len(shares)):
        part = F.when(_inside(i), F.col("x"))
        sketches += [F.percentile_approx(part, steps, F.lit(ACCURACY)).alias(f"q{i}"), F.count(part).alias(f"c{i}")]
    sketched = _meet(state, met.groupBy(*names).agg(*sketches), names)
    for i, s in enumerate(shares):
        low, high, _ = _place(s, F.col("n"))
        at = [(k - F.col(f"below{i}")) / F.col(f"c{i}") * STEPS for k in (low, high)]
        cut = [F.greatest(F.lit(0), F.floor(at[0]) - 1), F.least(F.lit(STEPS), F.ceil(at[1]) + 1)]
        sketched = sketched.withColumns({f"{x}{i}": F.get(f"q{i}", k.cast("int")) for x, k in zip("ab", cut, strict=True)}).drop(f"q{i}", f"c{i}")
    counts = []
    for i in range(len(shares)):
        lo, hi, a, b = (F.col(f"{x}{i}") for x in ("lo", "hi", "a", "b"))
        counts += [
            F.count_if((F.col("x") >= lo) & (F.col("x") < a)).alias(f"under{i}"),
            F.count_if(_inside(i, "a", "b")).alias(f"within{i}"),
            _strictly(a, b).alias(f"strict{i}"),
            F.count_if((F.col("x") >= lo) & (F.col("x") < b)).alias(f"upto{i}"),
            _strictly(lo, a).alias(f"left{i}"),
            _strictly(b, hi).alias(f"right{i}"),
        ]
    counted = _meet(sketched, _meet(rows, sketched, names).groupBy(*names).agg(*counts), names)
    new = {}
    for i, s in enumerate(shares):
        low, high, _ = _place(s, F.col("n"))
        v = {x: F.col(f"{x}{i}") for x in ("lo", "hi", "below", "in", "a", "b", "under", "within", "strict", "upto", "left", "right")}
        start = v["below"] + v["under"]
        hit, left, right = (low >= start) & (high < start + v["within"]), high < start, low >= start + v["within"]

        def choose(inner, before, after, old, hit=hit, left=left, right=right):
            """By where the places are; where they stand on both sides of an end of
            the sketch's cut, the bracket stays."""
            return F.when(hit, inner).when(left, before).when(right, after).otherwise(old)

        new |= {
            f"lo{i}": choose(v["a"], v["lo"], v["b"], v["lo"]),
            f"hi{i}": choose(v["b"], v["a"], v["hi"], v["hi"]),
            f"below{i}": choose(start, v["below"], v["below"] + v["upto"], v["below"]),
            f"in{i}": choose(v["strict"], v["left"], v["right"], v["in"]),
        }
    return counted.select(*names, "n", *[c.alias(k) for k, c in new.items()])
