"""Series: named points from wide, long and transposed tables, and their match.

Points of all series stay in one frame (series_name, date, value, ord); nothing
is held for each series on the driver but its name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers
from tidemark.functions.names import series_name, series_name_column
from tidemark.model import DiffReport
from tidemark.operators import autodetect, compare, shape
from tidemark.operators.pairing import correlations, greedy_pairs
from tidemark.operators.quantiles import grouped_percentiles
from tidemark.sources.readers import nan_to_null, with_order

ORDER = "_ord"
PREVIEW = 3
MIN_OVERLAP = 5
LEAST_R = 0.85
CLOSE = 0.02


@dataclass
class Extraction:
    points: DataFrame
    format: str
    used: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)

    def meta(self) -> DataFrame:
        """Rows, range and first points of each series."""
        return series_meta(self.points)


def _ready(df: DataFrame, date: str) -> tuple[DataFrame, list[str]]:
    df = numbers.null_texts_to_null(nan_to_null(with_order(df, ORDER)))
    fmt = dates.detect_date_format(df, date)
    typed = dict(df.dtypes)[date].startswith(("date", "timestamp"))
    when = F.col(f"`{date}`").cast("timestamp_ntz") if typed else dates.parse_date(F.col(f"`{date}`"), fmt)
    return df.withColumn("date", when).where("date is not null"), [f"dates read as {fmt.format}"]


def _number(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if numbers.is_numeric(dict(df.dtypes)[column]):
        return c.cast("double")
    return numbers.parse_number(c, numbers.detect_number_format(df, column))


def extract_wide(df: DataFrame, date: str, values: list[str]) -> Extraction:
    """One series for each value column."""
    ready, log = _ready(df, date)
    kept = [c for c in values if c in df.columns]
    wide = ready.select("date", ORDER, *[_number(ready, c).alias(c) for c in kept])
    points = wide.unpivot(["date", ORDER], [F.col(f"`{c}`") for c in kept], "series_name", "value").where("value is not null")
    return Extraction(points.select("series_name", "date", "value", F.col(ORDER).alias("ord")), "wide", [date, *kept], [c for c in df.columns if c not in (date, *kept)], log)


def extract_long(df: DataFrame, date: str, dims: list[str], value: str) -> Extraction:
    """One series for each combination of dimensions; ``(all)`` without any."""
    ready, log = _ready(df, date)
    points = ready.select(shape.series_key(dims).alias("series_name"), "date", _number(ready, value).alias("value"), F.col(ORDER).alias("ord"))
    return Extraction(points.where("value is not null"), "long", [date, *dims, value], [c for c in df.columns if c not in (date, *dims, value)], log)


def extract_long_multi(df: DataFrame, date: str, dims: list[str], values: list[str], metric: str = "metric") -> Extraction:
    """As long, with the value column's name as a further dimension if several."""
    kept = [c for c in values if c in df.columns]
    if len(kept) == 1:
        return extract_long(df, date, dims, kept[0])
    if not kept:
        none = df.sparkSession.createDataFrame([], "series_name string, date timestamp_ntz, value double, ord long")
        return Extraction(none, "long", [], list(df.columns), ["no value column"])
    ready, log = _ready(df, date)
    wide = ready.select("date", ORDER, *[F.col(f"`{c}`") for c in dims], *[_number(ready, c).alias(c) for c in kept])
    long_ = wide.unpivot(["date", ORDER, *dims], [F.col(f"`{c}`") for c in kept], metric, "value").where("value is not null")
    points = long_.select(shape.series_key([*dims, metric]).alias("series_name"), "date", "value", F.col(ORDER).alias("ord"))
    return Extraction(points, "long", [date, *dims, *kept], [c for c in df.columns if c not in (date, *dims, *kept)], log)


def extract_transposed(df: DataFrame, entity: str | None = None) -> Extraction:
    """Dates in the headers, a series in each row; blank entities are skipped."""
    entity = entity or df.columns[0]
    found = shape.header_dates([c for c in df.columns if c != entity], df.sparkSession)
    long_ = shape.transposed_to_long(numbers.null_texts_to_null(nan_to_null(df)), entity, found)
    fmt = numbers.detect_number_format(long_, "raw")
    points = long_.select("series_name", "date", numbers.parse_number(F.col("raw"), fmt).alias("value"))
    points = points.withColumn("ord", F.unix_micros(F.col("date").cast("timestamp")))
    return Extraction(points.where("value is not null"), "transposed", [entity, *found], [c for c in df.columns if c != entity and c not in found])


def extract_auto(df: DataFrame) -> Extraction:
    """By what the columns look like: dates, texts of few values, numbers."""
    facts = autodetect.column_facts(df)
    date = autodetect.detect_date_column(df)[0] or df.columns[0]
    dims = [c for c, f in facts.items() if c != date and f["kind"] == "string" and f["distinct"] <= autodetect.FEW_VALUES]
    values = [c for c, f in facts.items() if c != date and numbers.is_numeric(f["kind"])]
    if len(values) >= 2 and not dims:
        return extract_wide(df, date, values)
    if not values:
        return extract_long_multi(df, date, dims, [])
    return extract_long(df, date, dims, values[0])


def series_meta(points: DataFrame) -> DataFrame:
    w = W.partitionBy("series_name").orderBy("ord", "date")
    first = points.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= PREVIEW)
    preview = first.groupBy("series_name").agg(F.array_sort(F.collect_list(F.struct("_k", "date", "value"))).alias("preview"))
    totals = points.groupBy("series_name").agg(
        F.count("*").alias("row_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return totals.join(preview, "series_name")


def discard_reasons(points: DataFrame) -> DataFrame:
    """(series_name, reason): why a series can't be compared; null if it can."""
    facts = points.groupBy("series_name").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    reason = F.when(F.col("n") == 0, "no data").when(F.col("n") == 1, "one point").when(F.col("lo") == F.col("hi"), "constant")
    return facts.select("series_name", reason.alias("reason"))


# Matching.


@dataclass
class Match:
    source: str
    platform: str
    match_type: str
    confidence: float
    detail: str = ""


@dataclass
class Matching:
    matches: list[Match]
    unmatched_source: list[str]
    unmatched_platform: list[str]
    log: list[str] = field(default_factory=list)

    @property
    def total_source(self) -> int:
        return len(self.unmatched_source) + len({m.source for m in self.matches})

    @property
    def total_platform(self) -> int:
        return len(self.unmatched_platform) + len({m.platform for m in self.matches})

    def summary(self) -> dict[str, Any]:
        kinds: dict[str, int] = {}
        for m in self.matches:
            kinds[m.match_type] = kinds.get(m.match_type, 0) + 1
        n = len(self.matches)
        return {
            "matches": [m.__dict__ for m in self.matches], "by_type": kinds,
            "unmatched_source": self.unmatched_source, "unmatched_platform": self.unmatched_platform,
            "match_rate_source": n / self.total_source if self.total_source else 0.0,
            "match_rate_platform": n / self.total_platform if self.total_platform else 0.0,
        }

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m.source, m.platform, m.match_type, float(m.confidence), m.detail) for m in self.matches]
        return spark.createDataFrame(rows, "source string, platform string, match_type string, confidence double, detail string")


def match_correlated(source: DataFrame, platform: DataFrame, threshold: float, min_overlap: int = MIN_OVERLAP) -> list[Match]:
    """The platform with the best open correlation takes its source, and so on.

    Only the matching itself reaches the driver."""
    strong = correlations(source, platform, min_overlap, LEAST_R - 1e-9).withColumn("r", F.round("r", 12)).where(F.col("r") >= LEAST_R)
    out = []
    for row in greedy_pairs(strong, CLOSE).orderBy(F.desc("best"), "platform").collect():
        alone = row["best"] >= threshold and row["near"] == 1
        detail = f"r={row['r']:.4f}" + (" (by name among equals)" if row["boost"] and not alone else "")
        out.append(Match(row["source"], row["platform"], "correlation", row["r"], detail))
    return out


def match_names(sources: list[str], platforms: list[str]) -> list[Match]:
    """Names as they are, in any case, in normal form, as the longest part."""
    free, out = list(sources), []
    for p in platforms:
        low, norm = p.strip().lower(), series_name(p)
        rules = [
            ([s for s in free if s == p], 1.0, "exact"),
            ([s for s in free if s.strip().lower() == low], 0.98, "exact, other case"),
            ([s for s in free if series_name(s) == norm], 0.50, "normalized"),
            (sorted((s for s in free if series_name(s) and norm and (series_name(s) in norm or norm in series_name(s))), key=lambda s: -len(series_name(s))), 0.40, "part"),
        ]
        found = next(((c[0], score, how) for c, score, how in rules if c), None)
        if found:
            free.remove(found[0])
            out.append(Match(found[0], p, "name_only", found[1], found[2]))
    return out


def _open_names(points: DataFrame, taken: list[str]) -> list[str]:
    """Names of series that have no partner."""
    names = points.select("series_name").where("series_name is not null").distinct()
    used = points.sparkSession.createDataFrame([(t,) for t in taken], "series_name string")
    return [r[0] for r in names.join(used, "series_name", "left_anti").orderBy("series_name").collect()]


def match_series(source: DataFrame, platform: DataFrame, threshold: float = 0.95, min_overlap: int = MIN_OVERLAP) -> Matching:
    """Correlation first, names for what is left."""
    matches = match_correlated(source, platform, threshold, min_overlap)
    log = [f"{len(matches)} by correlation"]
    left = _open_names(source, [m.source for m in matches]), _open_names(platform, [m.platform for m in matches])
    more = match_names(*left)
    log.append(f"{len(more)} by name")
    used = {m.source for m in more}, {m.platform for m in more}
    return Matching(matches + more, *[[x for x in ns if x not in u] for ns, u in zip(left, used, strict=True)], log)


def apply_manual(matching: Matching, pairs: list[tuple[str, str]]) -> Matching:
    """Pairs that override; whoever loses a partner is unmatched again."""
    sources = {*matching.unmatched_source, *(m.source for m in matching.matches)}
    platforms = {*matching.unmatched_platform, *(m.platform for m in matching.matches)}
    log, manual = list(matching.log), []
    for s, p in pairs:
        if s not in sources or p not in platforms:
            log.append(f"unknown pair: {s!r}, {p!r}")
        elif any(s == m.source or p == m.platform for m in manual):
            log.append(f"already taken: {s!r}, {p!r}")
        else:
            manual.append(Match(s, p, "manual", 1.0, "set by hand"))
    taken_s, taken_p = {m.source for m in manual}, {m.platform for m in manual}
    kept = [m for m in matching.matches if m.source not in taken_s and m.platform not in taken_p] + manual
    return Matching(kept, sorted(sources - {m.source for m in kept}), sorted(platforms - {m.platform for m in kept}), log)


def drop_matches(matching: Matching, platforms: list[str]) -> Matching:
    kept = [m for m in matching.matches if m.platform not in platforms]
    gone = [m for m in matching.matches if m.platform in platforms]
    return Matching(kept, sorted({*matching.unmatched_source, *(m.source for m in gone)}), sorted({*matching.unmatched_platform, *(m.platform for m in gone)}), list(matching.log))


def merge_matchings(first: Matching, more: Matching) -> Matching:
    """Matches of a further source file for what the first left over."""
    done = {m.platform for m in first.matches}
    matches = [*first.matches, *[m for m in more.matches if m.platform not in done]]
    used = {m.source for m in matches}, {m.platform for m in matches}
    sources = {*first.unmatched_source, *more.unmatched_source, *(m.source for m in more.matches)} - used[0]
    platforms = {*first.unmatched_platform, *more.unmatched_platform} - used[1]
    return Matching(matches, sorted(sources), sorted(platforms), [*first.log, *more.log])


def name_key(name: Column) -> Column:
    return series_name_column(name)


# Comparing matched series.


def matched_pairs(source: DataFrame, platform: DataFrame, matches: DataFrame) -> DataFrame:
    """Points of all matched series side by side, in one join."""
    a = source.select(F.col("series_name").alias("source"), "date", F.col("value").alias("value_src"))
    b = platform.select(F.col("series_name").alias("platform"), "date", F.col("value").alias("value_plat"))
    return a.join(matches.select("source", "platform"), "source").join(b, ["platform", "date"])


def compare_matched(source: DataFrame, platform: DataFrame, matching: Matching, tolerance: float = 0.01, rel_tolerance: float | None = None) -> DiffReport:
    """Per-series statistics, scale and the largest differences of all matches."""
    spark = source.sparkSession
    pairs = matched_pairs(source, platform, matching.to_frame(spark)).dropna(subset=["value_src", "value_plat"])
    ratio = F.when((F.abs("value_src") > compare.TINY) & (F.abs("value_plat") > compare.TINY), F.col("value_plat") / F.col("value_src"))
    by = ["source", "platform"]
    pairs_ = pairs.withColumn("ratio", ratio)
    counts = pairs_.groupBy(*by).agg(F.count("ratio").alias("n"))
    medians = counts.join(grouped_percentiles(pairs_, by, F.col("ratio"), [0.5]).withColumnRenamed("p0", "median"), by, "left")
    near = pairs_.join(medians.select(*by, "median"), by).where((F.col("ratio") / F.nullif("median", F.lit(0.0))).between(0.2, 5.0))
    spread = near.groupBy(*by).agg(F.stddev_pop("ratio").alias("near_std"), F.count("*").alias("near_n"))
    spread = spread.join(grouped_percentiles(near, by, F.col("ratio"), [0.5]).withColumnRenamed("p0", "near_median"), by)
    scales = {}
    for r in medians.join(spread, ["source", "platform"], "left").collect():  # one row a match
        facts = {"n": r["n"], "median": r["median"] or 0.0, "near_n": r["near_n"] or 0, "near_median": r["near_median"], "near_std": r["near_std"]}
        scales[r["source"], r["platform"]] = compare.judge_scale(facts)
    factor = [(s, p, v["scale_factor"] if v["confidence"] in ("high", "medium") else 1.0) for (s, p), v in scales.items()]
    factors = spark.createDataFrame(factor, "source string, platform string, factor double")
    scaled = pairs.join(factors, ["source", "platform"]).withColumn("value_src", F.col("value_src") * F.col("factor")).drop("factor")
    diffs = compare.with_diffs(scaled, tolerance, rel_tolerance)
    report = DiffReport("source", "platform", tolerance, all_diffs=diffs)
    for r in compare.diff_totals(diffs, "source", "platform").orderBy("source", "platform").collect():
        row = r.asDict() | {"scale": scales[r["source"], r["platform"]]}
        row["match_pct"] = row["matched"] / row["comparable"] if row["comparable"] else 0.0
        report.series_summary.append(row)
        report.joined_rows += row["comparable"]
        report.matched += row["matched"]
        report.max_abs_diff = max(report.max_abs_diff, row["max_abs_diff"] or 0.0)
        report.max_rel_diff_pct = max(report.max_rel_diff_pct, row["max_rel_diff_pct"] or 0.0)
    report.different = report.joined_rows - report.matched
    report.match_pct = report.matched / report.joined_rows if report.joined_rows else 0.0
    if report.joined_rows:
        for k in ("mean_abs_diff", "mean_rel_diff_pct"):
            setattr(report, k, sum((s[k] or 0.0) * s["comparable"] for s in report.series_summary) / report.joined_rows)
    wrong = compare.top_diffs(diffs.where(~F.col("matched")), compare.TOP, "source", "platform", "date")
    report.top_diffs = [r.asDict() for r in wrong.collect()]
    return report
