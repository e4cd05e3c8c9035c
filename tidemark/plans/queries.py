"""Registered queries of the audit and reconciliation operators, with oracles.

Each query applies one operator to a whole table; the SQL beside it says the
same for DuckDB. Floats are rounded to four places on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers
from tidemark.functions.calendars import calendar
from tidemark.functions.names import series_name_column
from tidemark.operators import checks as K
from tidemark.operators import compare, quantiles, series, shape
from tidemark.operators.canonical import canonicalize

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str, *days: str):
    """Register a query; ``days`` leave both engines as ISO texts, as their
    clients show dates in types of their own."""

    def register(fn: Query) -> Query:
        add(fn.__name__, fn, oracle, days)
        return fn

    return register


def add(name: str, fn: Query, oracle: str, days: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in days})

    QUERIES[name] = run if days else fn
    texts = ", ".join(f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in days)
    ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({oracle})" if days else oracle


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, places: int = 4):
    return F.round(c, places)


# Integrity.

WITH_NULLS = """SELECT o_orderkey, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"""


def _with_nulls(spark, sf):
    return _t(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("priority"),
    )


@query(f"""WITH t AS ({WITH_NULLS}), n AS (SELECT count(*) AS n,
  count(*) - count(o_orderkey) AS a, count(*) - count(price) AS b, count(*) - count(priority) AS c FROM t)
SELECT 'o_orderkey' AS column, a AS nulls, round(a / n, 4) AS pct FROM n
UNION ALL SELECT 'price', b, round(b / n, 4) FROM n UNION ALL SELECT 'priority', c, round(c / n, 4) FROM n""")
def i1_null_percentage(spark, sf):
    return K.null_percentages(_with_nulls(spark, sf)).withColumn("pct", _r("pct"))


def _long_lineitem(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return shape.wide_to_long(items, "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


LONG = """SELECT l_shipdate, variable, "Value" FROM (SELECT l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
UNPIVOT INCLUDE NULLS ("Value" FOR variable IN (l_quantity, l_extendedprice, l_discount, l_tax))"""


@query(f"""SELECT variable, count(*) FILTER ("Value" = 0) AS zeros FROM ({LONG}) GROUP BY variable""")
def i2_zeros(spark, sf):
    return _long_lineitem(spark, sf).groupBy("variable").agg(F.count_if(F.col("Value") == 0).alias("zeros"))


@query("""SELECT (sum(c - 1))::BIGINT AS exact_duplicate_count
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)""")
def i3_exact_duplicates(spark, sf):
    return K.exact_duplicates(_t(spark, sf, "documents").select("text", "lang"))


@query("""SELECT round(min(l_discount), 4) AS min, round(max(l_discount), 4) AS max,
  count(*) FILTER (l_discount < 0.02) AS below, count(*) FILTER (l_discount > 0.08) AS above FROM lineitem""")
def i4_value_range(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_shipdate", "l_discount")
    aggs = K.table_aggregates(items, "l_discount", None, {"min": 0.02, "max": 0.08})
    return items.agg(*aggs).select(_r("min").alias("min"), _r("max").alias("max"), "below", "above")


# Schema.


@query("""WITH a AS (SELECT DISTINCT o_orderpriority AS value FROM orders),
  b AS (SELECT unnest(['1-URGENT', '2-HIGH', '9-NEVER']) AS value)
SELECT value, 'new' AS status FROM a WHERE value NOT IN (SELECT value FROM b)
UNION ALL SELECT value, 'missing' FROM b WHERE value NOT IN (SELECT value FROM a)""")
def s3_dimension_values(spark, sf):
    return K.dimension_diff(_t(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NEVER"])


# Temporal.


def _order_days(spark, sf):
    return K.date_index(_t(spark, sf, "orders"), "o_orderdate")


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
  g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM d),
  f AS (SELECT count(*) AS n_dates, median(gap)::DOUBLE AS median_gap, bool_or(isodow(day) > 5) AS weekends FROM g)
SELECT *, CASE WHEN median_gap <= 1.5 THEN CASE WHEN weekends THEN 'D' ELSE 'B' END WHEN median_gap <= 5 THEN 'B'
  WHEN median_gap <= 10 THEN 'W' WHEN median_gap <= 40 THEN 'M' WHEN median_gap <= 100 THEN 'Q' ELSE 'A' END AS inferred FROM f""")
def t1_frequency(spark, sf):
    return K.frequency_facts(_order_days(spark, sf))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day
EXCEPT SELECT day FROM d""", "day")
def t2_gaps(spark, sf):
    return K.gaps(_order_days(spark, sf), "D")


@query("""SELECT o_orderdate::DATE AS day, o_orderpriority, count(*) AS rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1""", "day")
def t3_duplicate_keys(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return K.duplicate_keys(orders, ["day", "o_orderpriority"])


@query("""SELECT max(o_orderdate)::DATE AS last_date,
  greatest(0, (DATE '2001-08-10' - 3) - max(o_orderdate)::DATE)::INTEGER AS days_stale FROM orders""", "last_date")
def t4_staleness(spark, sf):
    last = _t(spark, sf, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("last_date"))
    due = F.date_sub(F.lit(dt.date(2001, 8, 10)), 3)
    return last.withColumn("days_stale", F.greatest(F.lit(0), F.datediff(due, "last_date")))


@query("""SELECT min(o_orderdate)::DATE AS actual_start, max(o_orderdate)::DATE AS actual_end,
  min(o_orderdate)::DATE > DATE '1995-01-01' AS starts_late, max(o_orderdate)::DATE < DATE '2001-12-31' AS ends_early FROM orders""", "actual_start", "actual_end")
def t5_date_range(spark, sf):
    days = _order_days(spark, sf).agg(F.min("day").alias("actual_start"), F.max("day").alias("actual_end"))
    return days.withColumns(
        {
            "starts_late": F.col("actual_start") > F.lit(dt.date(1995, 1, 1)),
            "ends_early": F.col("actual_end") < F.lit(dt.date(2001, 12, 31)),
        }
    )


@query("""SELECT (isodow(day) - 1)::INTEGER AS weekday, count(*) AS n
FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) GROUP BY 1""")
def t6_weekdays(spark, sf):
    return K.weekday_histogram(_order_days(spark, sf))


def _calendar(frequency: str, condition: str):
    def fn(spark, sf):
        days = _order_days(spark, sf).agg(F.min("day").alias("a"), F.max("day").alias("b"))
        return calendar(days, "a", "b", frequency)

    oracle = f"""SELECT day FROM (SELECT unnest(generate_series(
      (SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS day)
      WHERE {condition}"""
    add(f"calendar_{frequency.lower()}", fn, oracle, ("day",))


for _f, _c in (
    ("D", "true"), ("B", "isodow(day) < 6"), ("W", "isodow(day) = 7"), ("M", "day(day) = 1"),
    ("Q", "day = date_trunc('quarter', day)::DATE"), ("A", "day = date_trunc('year', day)::DATE"),
):
    _calendar(_f, _c)


# Statistics.


@query("""WITH m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT event_id, event_type, round((value - a) / s, 4) AS z FROM events JOIN m USING (event_type)
WHERE s > 0 AND abs((value - a) / s) > 2.5""")
def a1_zscore_grouped(spark, sf):
    z = K.zscores(_t(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return z.where(F.abs("z") > 2.5).select("event_id", "event_type", _r("z").alias("z"))


@query("""WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events)
SELECT event_id, round((value - a) / s, 4) AS z FROM events, m WHERE abs((value - a) / s) > 2.5""")
def a1_zscore_global(spark, sf):
    z = K.zscores(_t(spark, sf, "events").select("event_id", "value"), "value", [])
    return z.where(F.abs("z") > 2.5).select("event_id", _r("z").alias("z"))


def _daily(spark, sf):
    return (
        _t(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("day"), "event_type")
        .agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("value"))
    )


DAILY = "SELECT ts::DATE AS day, event_type, sum(value::DECIMAL(20,6))::DOUBLE AS value FROM events GROUP BY 1, 2"


@query(f"""WITH c AS (SELECT day, event_type, abs(value / lag(value) OVER (PARTITION BY event_type ORDER BY day) - 1) AS change FROM ({DAILY}))
SELECT day, event_type, round(change, 4) AS change FROM c WHERE change > 0.1""", "day")
def a2_pct_change(spark, sf):
    daily = _daily(spark, sf).withColumn("ord", F.lit(0))
    changed = K.pct_changes(daily, "value", ["event_type"], "day", "ord")
    return changed.where("change > 0.1").select("day", "event_type", _r("change").alias("change"))


@query(f"""SELECT variable, count("Value") AS count, round(avg("Value"), 4) AS mean, round(stddev_samp("Value"), 4) AS std,
  round(min("Value"), 4) AS min, round(quantile_cont("Value", 0.25), 4) AS p25, round(median("Value"), 4) AS median,
  round(quantile_cont("Value", 0.75), 4) AS p75, round(max("Value"), 4) AS max, round(skewness("Value"), 4) AS skew
FROM ({LONG}) GROUP BY variable""")
def a3_distribution(spark, sf):
    v, long = F.col("Value"), _long_lineitem(spark, sf)
    facts = long.groupBy("variable").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.skewness(v).alias("g"),
    )
    # one row a variable; a variable without values has no percentiles
    places = F.broadcast(quantiles.counted_percentiles(long, ["variable"], v, [0.25, 0.5, 0.75]))
    return facts.join(places, "variable", "left").select(
        "variable", "count", _r("mean").alias("mean"), _r("std").alias("std"), _r("min").alias("min"),
        *[_r(f"p{i}").alias(n) for i, n in enumerate(("p25", "median", "p75"))], _r("max").alias("max"),
        _r(K.corrected_skew(F.col("g"), F.col("count"))).alias("skew"),
    )


# Consistency.


def _revised(orders: DataFrame) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice"))
    return orders.withColumn("o_totalprice", price)


@query("""WITH a AS (SELECT * FROM (SELECT o_orderdate::DATE AS day, o_orderpriority AS p, o_totalprice AS v,
    row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1),
  b AS (SELECT * FROM (SELECT o_orderdate::DATE AS day, o_orderpriority AS p,
    CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1.1 ELSE o_totalprice END AS v,
    row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1),
  j AS (SELECT a.day, a.v IS DISTINCT FROM b.v AS c FROM a JOIN b ON a.day IS NOT DISTINCT FROM b.day AND a.p IS NOT DISTINCT FROM b.p)
SELECT count(*) AS common_rows, count(*) FILTER (c) AS changed_rows, count(*) FILTER (c) AS changed_cells,
  count(*) AS total_cells, count(*) FILTER (c AND day < DATE '1998-01-01') AS old_revisions FROM j""")
def c1_c2_c3_revisions(spark, sf):
    orders = _t(spark, sf, "orders")
    dims, values = ["o_orderpriority"], ["o_totalprice"]
    now, before = (K.key_index(x, "o_orderdate", dims, values, "o_orderkey") for x in (orders, _revised(orders)))
    return K.revision_facts(now, before, dims, values, "1998-01-01")


# Shape and parsing.


@query(LONG, "l_shipdate")
def wide_to_long(spark, sf):
    return _long_lineitem(spark, sf)


@query("""SELECT o_orderkey, coalesce(lower(trim(CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END)), '<na>') || '|' ||
  coalesce(lower(trim(o_orderstatus)), '<na>') AS key FROM orders""")
def build_keys(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")))
    return orders.select("o_orderkey", shape.key(["p", "o_orderstatus"]).alias("key"))


@query("""SELECT o_orderkey, date_trunc('quarter', o_orderdate)::DATE AS q1, date_trunc('quarter', o_orderdate)::DATE AS q2,
  date_trunc('month', o_orderdate)::DATE AS es, date_trunc('month', o_orderdate)::DATE AS en, o_orderdate::DATE AS dmy,
  date_trunc('week', o_orderdate)::DATE AS week, date_trunc('year', o_orderdate)::DATE AS span FROM orders""", "q1", "q2", "es", "en", "dmy", "week", "span")
def parse_date_texts(spark, sf):
    d = F.col("o_orderdate")
    names = {k: F.element_at(F.array(*[F.lit(m.title()) for m in ms]), F.month(d)) for k, ms in (("es", dates.MONTHS_ES), ("en", dates.MONTHS_EN))}
    year = F.year(d).cast("string")
    thursday = F.date_add(F.trunc(d.cast("date"), "WEEK"), 3)
    texts = _t(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), year).alias("q1"),
        F.concat(F.quarter(d), F.lit("T"), year).alias("q2"),
        F.concat(names["es"], F.lit(" "), year).alias("es"),
        F.concat(F.substring(names["en"], 1, 3), F.lit("-"), F.substring(year, 3, 2)).alias("en"),
        F.date_format(d, "d/M/yyyy").alias("dmy"),
        F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")).alias("week"),
        F.concat(year, F.lit("/"), (F.year(d) + 1).cast("string")).alias("span"),
    )
    # two digits are years of this century
    this_century = F.when(F.year(d) < 2000, F.add_months(dates.parse_month_text(F.col("en"), "en").cast("date"), -1200))
    return texts.join(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(
        "o_orderkey",
        dates.parse_quarter(F.col("q1")).cast("date").alias("q1"),
        dates.parse_quarter(F.col("q2")).cast("date").alias("q2"),
        dates.parse_month_text(F.col("es"), "es").cast("date").alias("es"),
        F.coalesce(this_century, dates.parse_month_text(F.col("en"), "en").cast("date")).alias("en"),
        dates.parse_dmy(F.col("dmy")).cast("date").alias("dmy"),
        dates.parse_iso_week(F.col("week")).cast("date").alias("week"),
        dates.parse_year_span(F.col("span")).cast("date").alias("span"),
    )


@query("""SELECT o_orderkey, -round(o_totalprice, 2) AS european, round(o_totalprice, 2) AS standard FROM orders""")
def parse_number_texts(spark, sf):
    price = F.round("o_totalprice", 2)
    us = F.format_number(price, 2)
    eu = F.translate(us, ",.", ".,")
    texts = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("("), eu, F.lit(")")).alias("eu"), F.concat(F.lit("US$ "), us).alias("us"))
    european, standard = numbers.NumberFormat(",", "."), numbers.NumberFormat(".", ",", "US$")
    return texts.select(
        "o_orderkey",
        numbers.parse_number(F.col("eu"), european).alias("european"),
        numbers.parse_number(F.replace(F.col("us"), F.lit("US"), F.lit("")), standard).alias("standard"),
    )


@query("""SELECT c_custkey, trim(regexp_replace(lower(trim(c_name)), '[_\\-.|,;:\\s]+', ' ', 'g')) AS name FROM customer""")
def normalize_names(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", series_name_column(F.col("c_name")).alias("name"))


@query("""SELECT ts::DATE::TIMESTAMP AS "Date", lower(event_type) AS "Key", round(arg_max(value, event_id), 4) AS "Value" FROM events GROUP BY 1, 2""", "Date")
def canonicalize_events(spark, sf):
    events = _t(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    side = {"date_column": "day", "key_columns": ["event_type"], "value_column": "value"}
    return canonicalize(events, side, "event_id").df.withColumn("Value", _r("Value"))


# Compare.

MONTHLY = """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS "Date", lower(o_orderpriority) AS "Key",
  sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS v FROM orders GROUP BY 1, 2"""


def _monthly(spark, sf):
    return (
        _t(spark, sf, "orders")
        .groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("Date"), F.lower("o_orderpriority").alias("Key"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("Value"))
    )


def _published(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """A copy without Junes, with one key more and every fifth month off by 5 %."""
    month = F.month("Date")
    moved = df.where(month != 6).withColumn("Value", F.when(month == 5, F.col("Value") * 1.05).otherwise(F.col("Value")) * factor)
    more = moved.where(F.col("Key") == "1-urgent").withColumn("Key", F.lit("6-extra"))
    return moved.unionByName(more)


PUBLISHED = f"""p0 AS (SELECT "Date", "Key", CASE WHEN month("Date") = 5 THEN v * 1.05 ELSE v END AS v FROM s WHERE month("Date") <> 6),
p AS (SELECT * FROM p0 UNION ALL SELECT "Date", '6-extra', v FROM p0 WHERE "Key" = '1-urgent')"""
JOINED = f"""WITH s AS ({MONTHLY}), {PUBLISHED},
j AS (SELECT "Date", "Key", s.v AS value_src, p.v AS value_plat, abs(p.v - s.v) AS abs_diff,
  abs(p.v - s.v) / greatest(abs(s.v), 1e-10) * 100 AS rel_diff_pct FROM s JOIN p USING ("Date", "Key"))"""


def _compared(spark, sf):
    source = _monthly(spark, sf)
    return compare.with_diffs(compare.pair(source, _published(source)), 0.01)


@query(JOINED + """ SELECT count(*) AS comparable, count(*) FILTER (abs_diff <= 0.01 OR rel_diff_pct <= 1) AS matched,
  round(avg(abs_diff), 2) AS mean_abs_diff, round(max(abs_diff), 2) AS max_abs_diff,
  round(avg(rel_diff_pct), 4) AS mean_rel_diff_pct, round(max(rel_diff_pct), 4) AS max_rel_diff_pct FROM j""")
def compare_totals(spark, sf):
    t = compare.diff_totals(_compared(spark, sf))
    return t.select("comparable", "matched", *[_r(c, 2 if "abs" in c else 4).alias(c) for c in t.columns[2:]])


@query(JOINED + """ SELECT "Date", "Key", round(value_src, 2) AS value_src, round(value_plat, 2) AS value_plat,
  round(abs_diff, 2) AS abs_diff, round(rel_diff_pct, 4) AS rel_diff_pct, abs_diff <= 0.01 OR rel_diff_pct <= 1 AS matched FROM j
  ORDER BY round(abs_diff, 6) DESC, "Date", "Key" LIMIT 20""", "Date")
def compare_top20(spark, sf):
    diffs = _compared(spark, sf).withColumn("_a", F.col("abs_diff")).withColumn("abs_diff", _r("abs_diff", 6))
    top = compare.top_diffs(diffs).drop("_a")
    return top.select("Date", "Key", *[_r(c, 4 if "rel" in c else 2).alias(c) for c in ("value_src", "value_plat", "abs_diff", "rel_diff_pct")], "matched")


@query(f"""WITH s AS ({MONTHLY}), {PUBLISHED}
SELECT 'Date' AS kind, "Date"::VARCHAR AS value, 'source' AS side FROM (SELECT DISTINCT "Date" FROM s WHERE "Date" NOT IN (SELECT "Date" FROM p))
UNION ALL SELECT 'Key', "Key", 'platform' FROM (SELECT DISTINCT "Key" FROM p WHERE "Key" NOT IN (SELECT "Key" FROM s))""")
def compare_coverage(spark, sf):
    source = _monthly(spark, sf)
    parts = [compare.coverage_diff(source, _published(source), c).withColumn("kind", F.lit(c)) for c in ("Date", "Key")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH s AS ({MONTHLY}), {PUBLISHED},
r AS (SELECT p.v * 1000 / s.v AS ratio FROM s JOIN p USING ("Date", "Key")), m AS (SELECT median(ratio) AS med FROM r)
SELECT round(med, 4) AS ratio_median, 1000.0::DOUBLE AS scale_factor, 'high' AS confidence FROM m""")
def scale_detect(spark, sf):
    source = _monthly(spark, sf)
    found = compare.detect_scale(compare.pair(source, _published(source, 1000.0)))
    row = [(round(found["ratio_median"], 4), float(found["scale_factor"]), found["confidence"])]
    return spark.createDataFrame(row, "ratio_median double, scale_factor double, confidence string")


@query(f"""WITH s AS ({DAILY}), p AS (SELECT day + 1 AS day, event_type, value FROM s)
SELECT k AS shift, round(avg((abs(p.value - s.value) <= 0.01 * greatest(abs(s.value), 1e-10) OR abs(p.value - s.value) <= 0.01)::INT), 4) AS match_pct
FROM s JOIN (SELECT *, unnest([-1, 0, 1])::INTEGER AS k FROM p) p ON s.day = p.day + k AND s.event_type = p.event_type GROUP BY k""")
def shift_detect(spark, sf):
    daily = _daily(spark, sf).select(F.col("day").cast("timestamp_ntz").alias("Date"), F.col("event_type").alias("Key"), F.col("value").alias("Value"))
    moved = daily.withColumn("Date", F.col("Date") + F.expr("interval 1 day"))
    return compare.shift_matches(daily, moved, 0.01).withColumn("match_pct", _r("match_pct"))


# Series.


def _by(spark, sf, column):
    return (
        _t(spark, sf, "orders")
        .groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("date"), F.col(column).alias("series_name"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("value"))
    )


def BY(column):
    return f"SELECT date_trunc('month', o_orderdate) AS d, {column} AS n, sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS v FROM orders GROUP BY 1, 2"


@query(f"""SELECT a.n AS source, b.n AS platform, round(corr(a.v, b.v), 4) AS r, count(*) AS overlap
FROM ({BY('o_orderstatus')}) a JOIN ({BY('o_orderpriority')}) b USING (d) GROUP BY 1, 2 HAVING count(*) >= 5""")
def series_correlations(spark, sf):
    found = series.correlations(_by(spark, sf, "o_orderstatus"), _by(spark, sf, "o_orderpriority"))
    return found.withColumn("r", _r("r"))


@query("""SELECT n AS source, 'pub_' || n AS platform, 'correlation' AS match_type, 1.0::DOUBLE AS confidence
FROM (SELECT DISTINCT o_orderpriority AS n FROM orders)""")
def series_match(spark, sf):
    points = _by(spark, sf, "o_orderpriority")
    other = points.withColumns({"series_name": F.concat(F.lit("pub_"), "series_name"), "value": F.col("value") * 2 + 5})
    return series.match_series(points, other).to_frame(spark).drop("detail").withColumn("confidence", _r("confidence"))


@query(f"""WITH s AS ({BY('o_orderpriority')}), j AS (SELECT n, abs(CASE WHEN month(d) = 5 THEN v * 1.05 ELSE v END - v) AS a,
  abs(CASE WHEN month(d) = 5 THEN v * 1.05 ELSE v END - v) / greatest(abs(v), 1e-10) * 100 AS r FROM s)
SELECT n AS source, n AS platform, count(*) AS comparable, count(*) FILTER (a <= 0.01 OR r <= 1) AS matched,
  round(max(r), 4) AS max_rel_diff_pct FROM j GROUP BY n""")
def series_compare(spark, sf):
    points = _by(spark, sf, "o_orderpriority")
    other = points.withColumn("value", F.when(F.month("date") == 5, F.col("value") * 1.05).otherwise(F.col("value")))
    pairs = points.select("series_name").distinct().select(F.col("series_name").alias("source"), F.col("series_name").alias("platform"))
    diffs = compare.with_diffs(series.matched_pairs(points, other, pairs), 0.01)
    totals = compare.diff_totals(diffs, "source", "platform")
    return totals.select("source", "platform", "comparable", "matched", _r("max_rel_diff_pct").alias("max_rel_diff_pct"))


@query("""SELECT series_name, count(*) AS row_count, min(date) AS min_date, max(date) AS max_date, round(avg(value), 4) AS mean FROM (
  SELECT event_type || ' | ' || (user_id % 3)::VARCHAR AS series_name, ts::DATE::TIMESTAMP AS date, value FROM events) GROUP BY 1""", "min_date", "max_date")
def extract_long_series(spark, sf):
    events = _t(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type", (F.col("user_id") % 3).cast("string").alias("g"), "value")
    meta = series.extract_long(events, "day", ["event_type", "g"], "value").meta()
    return meta.select("series_name", "row_count", "min_date", "max_date", _r("mean").alias("mean"))


@query("""SELECT variable AS series_name, count(*) AS row_count, round(min("Value"), 4) AS min, round(max("Value"), 4) AS max
FROM (""" + LONG + """) GROUP BY 1""")
def extract_wide_series(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    meta = series.extract_wide(items, "l_shipdate", items.columns[1:]).meta()
    return meta.select("series_name", "row_count", _r("min").alias("min"), _r("max").alias("max"))
