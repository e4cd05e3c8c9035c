"""A source and a published table, aligned, diagnosed and compared."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import DiffReport
from tidemark.operators import autodetect
from tidemark.operators.canonical import canonicalize
from tidemark.operators.checks import exact_duplicates
from tidemark.operators.quantiles import exact_percentiles

#: Scale factors that are looked for.
FACTORS = [1e-9, 1e-6, 1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3, 1e6, 1e9]
TINY = 1e-10
TOP = 20
SHIFT_GAIN = 0.05


def pair(source: DataFrame, platform: DataFrame) -> DataFrame:
    """Inner join on (Date, Key)."""
    a = source.select("Date", "Key", F.col("Value").alias("value_src"))
    return a.join(platform.select("Date", "Key", F.col("Value").alias("value_plat")), ["Date", "Key"])


def with_diffs(joined: DataFrame, abs_tol: float, rel_tol: float | None = None) -> DataFrame:
    """abs_diff, rel_diff_pct and matched of each pair; pairs with a missing
    value are not matched."""
    rel_tol = abs_tol if rel_tol is None else rel_tol
    gap = F.abs(F.col("value_plat") - F.col("value_src"))
    rel = gap / F.greatest(F.abs("value_src"), F.lit(TINY)) * 100
    fits = (F.col("abs_diff") <= abs_tol) | (F.col("rel_diff_pct") <= rel_tol * 100)
    return joined.withColumns({"abs_diff": gap, "rel_diff_pct": rel}).withColumn("matched", F.coalesce(fits, F.lit(False)))


def diff_totals(diffs: DataFrame, *by: str) -> DataFrame:
    return diffs.groupBy(*by).agg(
        F.count("*").alias("comparable"),
        F.count_if("matched").alias("matched"),
        F.avg("abs_diff").alias("mean_abs_diff"),
        F.max("abs_diff").alias("max_abs_diff"),
        F.avg("rel_diff_pct").alias("mean_rel_diff_pct"),
        F.max("rel_diff_pct").alias("max_rel_diff_pct"),
    )


def top_diffs(diffs: DataFrame, n: int = TOP, *ties: str) -> DataFrame:
    return diffs.orderBy(F.desc_nulls_last("abs_diff"), *(ties or ("Date", "Key"))).limit(n)


def coverage_diff(source: DataFrame, platform: DataFrame, column: str) -> DataFrame:
    """(value, side) of values that one side alone has."""
    a, b = (x.select(F.col(column).cast("string").alias("value")).distinct() for x in (source, platform))
    lost = a.join(b, "value", "left_anti").withColumn("side", F.lit("source"))
    return lost.unionByName(b.join(a, "value", "left_anti").withColumn("side", F.lit("platform")))


# Scale.


def ratios(joined: DataFrame) -> DataFrame:
    big = lambda c: F.abs(c) > TINY
    return joined.where(big("value_src") & big("value_plat")).select((F.col("value_plat") / F.col("value_src")).alias("ratio"))


def scale_facts(joined: DataFrame) -> dict[str, Any]:
    """Count and median of all ratios; the same and the spread of those within
    a fifth and five times the median. All pairs count, none are sampled."""
    r = ratios(joined).persist()  # one narrow column, read by each round
    try:
        median = exact_percentiles(r, F.col("ratio"), [0.5])[0]
        if median is None or median <= 0:
            return {"n": r.count(), "median": median, "near_n": 0, "near_median": None, "near_std": None}
        close = (F.col("ratio") / median).between(0.2, 5.0)
        near = F.when(close, F.col("ratio"))
        spread = r.agg(F.count("*").alias("n"), F.count(near).alias("near_n"), F.stddev_pop(near).alias("near_std")).first().asDict()
        return {"median": median, "near_median": exact_percentiles(r.where(close), F.col("ratio"), [0.5])[0], **spread}
    finally:
        r.unpersist()


def judge_scale(facts: dict[str, Any]) -> dict[str, Any]:
    def verdict(ratio, factor, confidence, label):
        rounded = None if ratio is None else round(ratio, 8)
        return {"ratio_median": rounded, "scale_factor": factor, "confidence": confidence, "suggested_correction": factor, "label": label}

    if facts["n"] < 3:
        return verdict(None, 1.0, None, "insufficient data")
    if facts["median"] <= 0:
        return verdict(facts["median"], 1.0, None, "ratio is not positive: signs are mixed")
    median = facts["near_median"] if facts["near_n"] >= 3 else facts["median"]
    spread = facts["near_std"] / abs(median) if facts["near_n"] >= 3 else 1.0
    factor = min(FACTORS, key=lambda f: abs(math.log10(median) - math.log10(f)))
    away = abs(math.log10(median) - math.log10(factor))
    if factor == 1.0 and away < 0.05:
        return verdict(median, factor, None, "no scale difference")
    confidence = "high" if away < 0.1 and spread < 0.1 else "medium" if away < 0.3 and spread < 0.3 else "low"
    label = "no scale difference"
    if factor != 1.0:
        label = f"platform is {'×' if factor > 1 else '÷'} {max(factor, 1 / factor):g} of the source"
    return verdict(median, factor, confidence, label)


def detect_scale(joined: DataFrame) -> dict[str, Any]:
    return judge_scale(scale_facts(joined))


# Shift by a day.


#: Days of one window of dates; the days at its edges are sent to two windows.
SHIFT_WINDOW = 64
_DAY = 86_400_000_000


def shift_matches(source: DataFrame, platform: DataFrame, tolerance: float) -> DataFrame:
    """(shift, match_pct) with the platform's dates moved by -1, 0 and 1 days.

    Both tables are dealt by key and window of dates and merged in the order of
    time: a source row looks at the platform's values a day before, at, and a day
    after its own time. So the platform is shuffled once (and the first and last
    day of each window twice), and a key's rows are spread over its windows."""
    t = F.unix_micros(F.col("Date").cast("timestamp")).alias("t")
    window = F.floor(F.col("t") / F.lit(SHIFT_WINDOW * _DAY))
    src = source.select("Key", t, F.col("Value").alias("value_src")).withColumn("window", window)
    src = src.withColumns({"is_src": F.lit(True), "values": F.lit(None).cast("array<double>")})
    held = platform.groupBy("Key", "Date").agg(F.collect_list(F.col("Value").cast("double")).alias("values"), F.count_if(F.col("Value").isNull()).alias("nulls"))
    held = held.select("Key", t, F.concat("values", F.array_repeat(F.lit(None).cast("double"), F.col("nulls").cast("int"))).alias("values"))
    near = [F.floor((F.col("t") + F.lit(d * _DAY)) / F.lit(SHIFT_WINDOW * _DAY)) for d in (-1, 0, 1)]
    held = held.withColumn("window", F.explode(F.array_distinct(F.array(*near))))
    held = held.withColumns({"is_src": F.lit(False), "value_src": F.lit(None).cast("double")})
    rows = src.withColumn("value_src", F.col("value_src").cast("double")).unionByName(held).where("t is not null and Key is not null")
    w = W.partitionBy("Key", "window").orderBy("t")
    # moved by a shift, the platform's date is the source's
    at = {s: F.first("values", ignorenulls=True).over(w.rangeBetween(-s * _DAY, -s * _DAY)) for s in (-1, 0, 1)}
    met = rows.withColumns({f"at{s}": c for s, c in at.items()}).where("is_src")
    shifts = F.array(*[F.struct(F.lit(s).alias("shift"), F.col(f"at{s}").alias("values")) for s in at])
    pairs = met.select("value_src", F.inline(shifts)).select("shift", "value_src", F.explode("values").alias("value_plat"))
    gap = F.abs(F.col("value_plat") - F.col("value_src"))
    fits = (gap <= tolerance * F.greatest(F.abs("value_src"), F.lit(TINY))) | (gap <= tolerance)
    return pairs.groupBy("shift").agg(F.avg(F.coalesce(fits, F.lit(False)).cast("double")).alias("match_pct"))


def judge_shift(found: dict[int, float]) -> int | None:
    best, at = found.get(0, 0.0), 0
    for shift in (1, -1):
        if found.get(shift, 0.0) > best + SHIFT_GAIN:
            best, at = found[shift], shift
    return at or None


def compare_datasets(source: DataFrame, platform: DataFrame, config: dict[str, Any]) -> DiffReport:
    """Compare two tables under ``config`` (source, platform, tolerance, names).

    Without a platform date column, columns are mapped by name and the source's
    settings hold for both."""
    tolerance = config.get("tolerance", 0.01)
    report = DiffReport(config.get("source_name", "source"), config.get("platform_name", "platform"), tolerance)
    side_a, side_b = config.get("source", {}), config.get("platform", {})
    if not side_b.get("date_column"):
        mapping = autodetect.map_columns(source.columns, platform.columns)
        platform = platform.withColumnsRenamed(autodetect.renames(mapping))
        report.column_mapping = [m.__dict__ for m in mapping]
        side_b = side_a
    a, b = canonicalize(source, side_a), canonicalize(platform, side_b)
    report.log = [*[f"source: {x}" for x in a.log], *[f"platform: {x}" for x in b.log]]
    raw = {k: exact_duplicates(x).first()["exact_duplicate_count"] for k, x in (("source", source), ("platform", platform))}
    ca, cb = a.df.persist(), b.df.persist()
    joined = pair(ca, cb).persist()
    try:
        spans = {k: x.agg(F.count("*").alias("n"), F.min("Date").alias("a"), F.max("Date").alias("b")).first() for k, x in (("source", ca), ("platform", cb))}
        report.source_rows, report.platform_rows = spans["source"]["n"], spans["platform"]["n"]
        report.coverage = {"raw_duplicates": raw, "ranges": {k: [str(r["a"]), str(r["b"])] for k, r in spans.items()}}
        for column, name in (("Date", "dates"), ("Key", "keys")):
            diff = coverage_diff(ca, cb, column)
            counts = {r["side"]: r["n"] for r in diff.groupBy("side").agg(F.count("*").alias("n")).collect()}
            report.coverage[f"missing_{name}"] = counts.get("source", 0)
            report.coverage[f"extra_{name}"] = counts.get("platform", 0)
            report.coverage[f"{name}_sample"] = [tuple(r) for r in diff.orderBy("side", "value").limit(TOP).collect()]
        report.joined_rows = joined.count()
        if not report.joined_rows:
            return report
        report.scale = detect_scale(joined)
        fixed = corrected(joined, report.scale)
        diffs = with_diffs(fixed, tolerance)
        totals = diff_totals(diffs).first()
        report.matched, report.different = totals["matched"], report.joined_rows - totals["matched"]
        report.match_pct = totals["matched"] / report.joined_rows
        for k in ("mean_abs_diff", "max_abs_diff", "mean_rel_diff_pct", "max_rel_diff_pct"):
            setattr(report, k, totals[k] or 0.0)
        report.top_diffs = [r.asDict() for r in top_diffs(diffs).collect()]
        report.temporal_shift = judge_shift({r["shift"]: r["match_pct"] for r in shift_matches(ca, cb, tolerance).collect()})
        report.all_diffs = with_diffs(corrected(pair(a.df, b.df), report.scale), tolerance)
        return report
    finally:
        for x in (joined, ca, cb):
            x.unpersist()


def corrected(joined: DataFrame, scale: dict[str, Any]) -> DataFrame:
    """The source brought to the platform's scale where that is sure enough."""
    if scale.get("confidence") in ("high", "medium") and scale["scale_factor"] != 1.0:
        return joined.withColumn("value_src", F.col("value_src") * F.lit(scale["scale_factor"]))
    return joined


def filter_diffs(diffs: DataFrame, key: str | None = None, least_rel_pct: float = 0.0) -> DataFrame:
    wanted: Column = F.col("rel_diff_pct") >= least_rel_pct
    if key is not None:
        wanted = wanted & (F.col("Key") == key)
    return diffs.where(wanted).orderBy(F.desc("abs_diff"), "Date", "Key")
