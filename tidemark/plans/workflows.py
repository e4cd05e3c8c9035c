"""Registered queries of whole workflows: the audit report, inference of settings,
sheets brought to one shape, comparison reports, matching by name and by hand.

As in ``queries``, which these join, every query has SQL beside it that says the
same for DuckDB.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers
from tidemark.operators import autodetect, compare, quantiles, series
from tidemark.operators import checks as K
from tidemark.operators.audit import audit_dataset
from tidemark.operators.canonical import canonicalize
from tidemark.plans.queries import (
    DAILY, MONTHLY, ORACLES, PUBLISHED, QUERIES, _daily, _monthly, _published, _r, _revised, _t, query,
)

__all__ = ["ORACLES", "QUERIES", "audit_orders"]

AS_OF = dt.date(2001, 8, 10)

# The audit report.

ORDERS_CONFIG = {
    "dataset_name": "orders",
    "date_column": "o_orderdate",
    "dimension_columns": ["o_orderpriority"],
    "value_column": "o_totalprice",
    "expected_frequency": "D",
    "value_range": {"min": 1500.0, "max": 400000.0},
    "allow_zero_values": False,
    "expected_dimensions": {"o_orderpriority": ["1-URGENT", "2-HIGH", "9-NEVER"]},
    "outlier_zscore_threshold": 1.72,
    "revision_whitelist": {"enabled": True},
    "severity_overrides": {"I4_value_range": "BLOCKER", "T5": "INFO"},
}


def _frequency_sql(gap: str, weekend: str) -> str:
    """The frequency of days by their median gap and whether weekends are among them."""
    return f"""CASE WHEN {gap} <= 1.5 THEN CASE WHEN {weekend} THEN 'D' ELSE 'B' END WHEN {gap} <= 5 THEN 'B' WHEN {gap} <= 10 THEN 'W'
  WHEN {gap} <= 40 THEN 'M' WHEN {gap} <= 100 THEN 'Q' ELSE 'A' END"""


def _json_list(values: str, order: str) -> str:
    return f"'[' || coalesce(string_agg('\"' || {values} || '\"', ', ' ORDER BY {order}), '') || ']'"


def _row(check: str, name: str, category: str, severity: str, passed: str, message: str, details: str, tables: str = "") -> str:
    return f"""SELECT '{check}' AS check_id, '{name}' AS check_name, '{category}' AS category, '{severity}' AS severity,
  ({passed})::BOOLEAN AS passed, {message} AS message, {details} AS details, '' AS recommendation {tables and 'FROM ' + tables}"""


_ROWS = [
    _row("S1", "required_columns_present", "schema", "BLOCKER", "true", "'all required columns are there'",
         """'{"missing": [], "present": ["o_orderdate", "o_orderpriority", "o_totalprice"]}'"""),
    _row("S2", "data_types", "schema", "WARNING", "true", "'types are as expected'", "'{}'"),
    _row("S3", "dimension_values", "schema", "WARNING", "lost = '[]' AND fresh = '[]'", "'dimension values differ from the expected'",
         """'{"o_orderpriority_missing": ' || lost || ', "o_orderpriority_new": ' || fresh || '}'""", "dims"),
    _row("T1", "frequency_mismatch", "temporal", "BLOCKER", "f = 'D'", "'frequency is ' || f || ', expected D'",
         """'{"expected": "D", "inferred": "' || f || '", "n_unique_dates": ' || n || '}'""", "frequency"),
    _row("T2", "gap_detection", "temporal", "BLOCKER", "n = 0", "n || ' expected dates are missing'",
         """'{"gap_count": ' || n || ', "gaps_sample": ' || sample || '}'""", "gaps"),
    _row("T3", "duplicate_date_dimension_keys", "temporal", "BLOCKER", "n = 0", "n || ' rows share a key'",
         """'{"duplicate_rows": ' || n || ', "sample": [' || sample || ']}'""", "doubles"),
    _row("T4", "staleness", "temporal", "WARNING", "stale <= 0", "'last date is ' || b",
         """'{"acceptable_lag_days": 3, "days_stale": ' || greatest(0, stale) || ', "last_date": "' || b || '", "today": "2001-08-10"}'""",
         "(SELECT *, (DATE '2001-08-10' - 3) - b AS stale FROM span)"),
    _row("T5", "date_range_validation", "temporal", "INFO", "true", "'dates from ' || a || ' to ' || b",
         """'{"actual_end": "' || b || '", "actual_start": "' || a || '"}'""", "span"),
    _row("T6", "day_pattern_detection", "temporal", "INFO", "true", "weekend || ' weekend dates, 0 holiday dates'",
         """'{"day_of_week_distribution": {' || spread || '}, "holiday_dates_count": 0, "weekend_dates_count": ' || weekend || '}'""", "weekdays"),
    _row("I1", "null_percentage", "integrity", "WARNING", "true", "'0 columns over 5.0% nulls'", """'{"threshold": 0.05, "violating_columns": {}}'"""),
    _row("I2", "suspicious_zeros", "integrity", "WARNING", "zeros = 0", "zeros || ' zeros'",
         """'{"zero_counts": {' || CASE WHEN zeros > 0 THEN '"o_totalprice": ' || zeros ELSE '' END || '}}'""", "totals"),
    _row("I3", "exact_duplicate_rows", "integrity", "BLOCKER", "n = 0", "n || ' repeated rows'", """'{"exact_duplicate_count": ' || n || '}'""",
         "(SELECT coalesce(sum(c - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))"),
    _row("I4", "value_range", "integrity", "BLOCKER", "below = 0 AND above = 0", "below || ' below, ' || above || ' above'",
         """'{' || CASE WHEN above > 0 THEN '"o_totalprice_above_max": ' || above || ', ' ELSE '' END || '"o_totalprice_actual_max": ' || hi ||
           ', "o_totalprice_actual_min": ' || lo || CASE WHEN below > 0 THEN ', "o_totalprice_below_min": ' || below ELSE '' END || '}'""", "totals"),
    _row("A1", "zscore_outliers", "statistical", "WARNING", "n = 0", "n || ' outliers'",
         """CASE WHEN n = 0 THEN '{}' ELSE '{"o_totalprice": {"count": ' || n || ', "pct": ' || pct || '}, "o_totalprice_worst_z": [' || worst || ']}' END""", "outliers"),
    _row("A2", "abrupt_pct_change", "statistical", "WARNING", "n = 0", "n || ' abrupt changes'",
         """CASE WHEN n = 0 THEN '{}' ELSE '{"o_totalprice": {"count": ' || n || ', "max_pct_change": ' || m || '}}' END""", "jumps"),
    _row("A3", "distribution_summary", "statistical", "INFO", "true", "n || ' values'",
         """'{"o_totalprice": {"count": ' || n || ', "max": ' || hi || ', "mean": ' || mean || ', "median": ' || median || ', "min": ' || lo ||
           ', "p25": ' || p25 || ', "p75": ' || p75 || ', "skew": ' || skew || ', "std": ' || std || '}}'""", "totals"),
    _row("C1", "historical_rewrites", "consistency", "WARNING", "changed = 0", "changed || ' of ' || n || ' common rows changed'",
         """'{"changed_rows": ' || changed || ', "pct_changed": ' || share || ', "total_common_rows": ' || n || '}'""", "revised"),
    _row("C2", "pct_cells_modified", "consistency", "INFO", "changed / n <= 0.1", "changed || ' cells changed'",
         """'{"changed_cells": ' || changed || ', "pct_changed": ' || share || ', "threshold": 0.1, "total_cells": ' || n || '}'""", "revised"),
    _row("C3", "revision_whitelist", "consistency", "WARNING", "old = 0 AND changed / n <= 0.1", "old || ' old revisions'",
         """'{"max_age_days": 90, "max_pct": 0.1, "old_revisions_beyond_age": ' || old || ', "pct_revised": ' || share ||
           ', "recent_revisions": ' || (changed - old) || ', "total_revised_rows": ' || changed || '}'""", "revised"),
]

AUDIT_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, o_orderpriority AS p, o_totalprice AS v FROM orders),
days AS (SELECT DISTINCT day FROM o),
span AS (SELECT min(day) AS a, max(day) AS b FROM o),
dims AS (SELECT
  (SELECT {_json_list('x', 'x')} FROM (SELECT unnest(['1-URGENT', '2-HIGH', '9-NEVER']) AS x EXCEPT SELECT p FROM o)) AS lost,
  (SELECT {_json_list('p', 'p')} FROM (SELECT DISTINCT p FROM o WHERE p NOT IN ('1-URGENT', '2-HIGH', '9-NEVER'))) AS fresh),
frequency AS (SELECT count(*) AS n, {_frequency_sql('median(gap)', 'bool_or(isodow(day) > 5)')} AS f
  FROM (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM days)),
lost_days AS (SELECT unnest(generate_series((SELECT a FROM span), (SELECT b FROM span), INTERVAL 1 DAY))::DATE AS day EXCEPT SELECT day FROM days),
gaps AS (SELECT (SELECT count(*) FROM lost_days) AS n, {_json_list('day', 'day')} AS sample FROM (SELECT * FROM lost_days ORDER BY day LIMIT 20)),
twice AS (SELECT day, p, count(*) AS c FROM o GROUP BY 1, 2 HAVING count(*) > 1),
doubles AS (SELECT (SELECT coalesce(sum(c), 0)::BIGINT FROM twice) AS n,
  coalesce(string_agg('{{"o_orderdate": "' || day || 'T00:00:00", "o_orderpriority": "' || p || '"}}', ', ' ORDER BY day, p), '') AS sample
  FROM (SELECT * FROM twice ORDER BY day, p LIMIT 5)),
weekdays AS (SELECT string_agg('"' || w || '": ' || n, ', ' ORDER BY w) AS spread, coalesce(sum(n) FILTER (w > 4), 0)::BIGINT AS weekend
  FROM (SELECT isodow(day) - 1 AS w, count(*) AS n FROM days GROUP BY 1)),
totals AS (SELECT count(*) AS n, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 1500) AS below, count(*) FILTER (v > 400000) AS above,
  min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(skewness(v), 4) AS skew, round(median(v), 4) AS median,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75 FROM o),
moments AS (SELECT p, avg(v) AS a, stddev_samp(v) AS s FROM o GROUP BY p),
wild AS (SELECT (v - a) / s AS z FROM o JOIN moments USING (p) WHERE abs((v - a) / s) > 1.72),
outliers AS (SELECT (SELECT count(*) FROM wild) AS n, round((SELECT count(*) FROM wild) / (SELECT count(*) FROM o), 4) AS pct,
  string_agg(round(z, 2)::VARCHAR, ', ' ORDER BY abs(z) DESC) AS worst FROM (SELECT z FROM wild ORDER BY abs(z) DESC LIMIT 3)),
jumps AS (SELECT count(*) AS n, max(c) AS m FROM (SELECT abs(v / lag(v) OVER (PARTITION BY p ORDER BY day, k) - 1) AS c FROM o) WHERE c > 0.5),
firsts AS (SELECT * FROM (SELECT *, CASE WHEN k % 10 = 0 THEN v * 1.1 ELSE v END AS w, row_number() OVER (PARTITION BY day, p ORDER BY k) AS r FROM o) WHERE r = 1),
revised AS (SELECT count(*) AS n, count(*) FILTER (v <> w) AS changed, count(*) FILTER (v <> w AND day < DATE '2001-08-10' - 90) AS old,
  round(count(*) FILTER (v <> w) / count(*), 4) AS share FROM firsts)
""" + " UNION ALL ".join(f"({row})" for row in _ROWS)


@query(AUDIT_SQL)
def audit_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All nineteen checks of ``orders`` against a revised snapshot, one row each."""
    orders = _t(spark, sf, "orders")
    report = audit_dataset(orders, ORDERS_CONFIG, snapshot=_revised(orders), as_of=AS_OF, order="o_orderkey")
    return report.to_frame(spark)


# Inference.

#: (table, date column, whole number columns, other number columns, text columns), in table order.
INFERRED = [
    ("orders", "o_orderdate", ["o_orderkey", "o_custkey"], ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
    ("events", "ts", ["event_id", "user_id"], ["value"], ["event_type", "props"]),
    ("customer", None, ["c_custkey", "c_nationkey"], ["c_acctbal"], ["c_name", "c_mktsegment"]),
]


def _facts_sql(table: str, whole: list[str], reals: list[str], texts: list[str]) -> str:
    kinds = [*[(c, "whole") for c in whole], *[(c, "real") for c in reals], *[(c, "text") for c in texts]]
    parts = []
    for i, (c, kind) in enumerate(kinds):
        number = f"count(*) FILTER ({c} = 0) / count({c}) AS zeros, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi"
        parts.append(
            f"SELECT '{c}' AS c, {i} AS i, '{kind}' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, "
            + (number if kind != "text" else "NULL AS zeros, NULL AS lo, NULL AS hi")
            + f" FROM {table}"
        )
    marks = " OR ".join(f"contains(c, '{m}')" for m in autodetect.ID_MARKS)
    return f"SELECT *, kind = 'whole' AND ({marks}) AND d >= 0.97 * n AS is_id FROM ({' UNION ALL '.join(parts)})"


def _inferred_sql(table: str, date: str | None, whole: list[str], reals: list[str], texts: list[str]) -> str:
    facts = f"({_facts_sql(table, whole, reals, texts)})"
    numeric = f"(SELECT * FROM {facts} WHERE kind <> 'text' AND NOT is_id)"
    dims = f"(SELECT * FROM {facts} WHERE kind = 'text' AND NOT (n < 10000 AND d > 1000))"
    rate = f"(SELECT max(zeros) AS r FROM {numeric})"
    # every column of these tables counts for nulls, dates too; none has any
    rows = [
        ("date_column", f"'{date}'" if date else "NULL", "NULL", "high" if date else "low", ""),
        ("format", "'wide'", "NULL", "high", ""),
        ("value_columns", "string_agg(c, ',' ORDER BY i)", "NULL", "high", numeric),
        ("dimension_columns", "string_agg(c, ',' ORDER BY i)", "NULL", "medium", dims),
        ("max_null_pct", "NULL", "CASE WHEN sum(nulls) / sum(n) < 0.01 THEN 0.02 ELSE round(sum(nulls) / sum(n) + 0.02, 3) END", "medium", facts),
        ("allow_zero_values", "(r = 0 OR r >= 0.05)::VARCHAR", "NULL", "medium", rate),
        ("value_range.min", "NULL", "CASE WHEN min(lo) >= 0 THEN round(greatest(0, min(lo) - 0.1 * (max(hi) - min(lo))), 2) ELSE round(min(lo) - 0.1 * (max(hi) - min(lo)), 2) END", "medium", numeric),
        ("value_range.max", "NULL", "round(max(hi) + 0.1 * (max(hi) - min(lo)), 2)", "medium", numeric),
    ]
    if date:
        gap = f"(SELECT median(g) AS g, bool_or(isodow(day) > 5) AS w FROM (SELECT day, day - lag(day) OVER (ORDER BY day) AS g FROM (SELECT DISTINCT {date}::DATE AS day FROM {table})))"
        lag = f"(SELECT DATE '2001-08-10' - max({date})::DATE AS l FROM {table})"
        rows.append(("expected_frequency", _frequency_sql("g", "w"), "NULL", "high", gap))
        rows.append(("acceptable_lag_days", "NULL", "CASE WHEN l BETWEEN 0 AND 3 THEN 2 WHEN l BETWEEN 4 AND 3650 THEN l + 1 ELSE 3 END", "medium", lag))
        rows.append(("expected_start", f"strftime(min({date}), '%Y-%m-%d')", "NULL", None, table))
    else:
        rows.append(("expected_frequency", "'D'", "NULL", "low", ""))
        rows.append(("acceptable_lag_days", "NULL", "3", "low", ""))
        rows.append(("expected_start", "NULL", "NULL", None, ""))
    for c in texts:
        few = f"(SELECT {c} AS v, count(DISTINCT {c}) OVER () AS d, count(*) OVER () AS n FROM {table})"
        listed = "CASE WHEN max(d) <= 50 THEN string_agg(DISTINCT v, ',' ORDER BY v) END"
        rows.append((f"expected_dimensions.{c}", listed, "NULL", None, f"{few} HAVING NOT (max(n) < 10000 AND max(d) > 1000)"))
    out = []
    for field, text, number, confidence, source in rows:
        sure = f"'{confidence}'" if confidence else "NULL"
        if field == "acceptable_lag_days" and date:
            sure = "CASE WHEN l BETWEEN 0 AND 3650 THEN 'medium' ELSE 'low' END"
        out.append(f"SELECT '{table}' AS \"table\", '{field}' AS field, ({text})::VARCHAR AS text, ({number})::DOUBLE AS number, {sure} AS confidence {source and 'FROM ' + source}")
    return " UNION ALL ".join(f"({x})" for x in out)


@query(" UNION ALL ".join(_inferred_sql(*x) for x in INFERRED))
def inferred_configs(spark, sf):
    """The settings inferred from three tables, one row for each."""
    rows = []
    for table, *_ in INFERRED:
        config = autodetect.auto_detect_config(_t(spark, sf, table), table, AS_OF)
        sure = {n["field"]: n["confidence"] for n in config["_detection_notes"]}
        flat: dict = {}
        for field in (*sure, "expected_start", "expected_dimensions"):
            value = config[field]
            flat |= {f"{field}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {field: value}
        for field, value in flat.items():
            number = isinstance(value, int | float) and not isinstance(value, bool)
            text = ",".join(value) if isinstance(value, list) else json.dumps(value) if isinstance(value, bool) else value
            confidence = sure.get(field, sure.get(field.split(".")[0]))
            rows.append((table, field, None if number else text, float(value) if number else None, confidence))
    return spark.createDataFrame(rows, "table string, field string, text string, number double, confidence string")


def _roles_sql(table: str, date: str | None, whole: list[str], reals: list[str], texts: list[str]) -> str:
    role = """CASE WHEN is_id OR (side = 'platform' AND kind = 'text' AND d <= 2) THEN 'ignore' WHEN kind <> 'text' THEN 'value'
      WHEN d <= 50 THEN 'dimension' WHEN side = 'platform' THEN 'series' ELSE 'ignore' END"""
    found = f"SELECT '{table}' AS \"table\", side, c AS \"column\", {role} AS role FROM ({_facts_sql(table, whole, reals, texts)}), (SELECT unnest(['source', 'platform']) AS side)"
    return found + (f" UNION ALL SELECT '{table}', unnest(['source', 'platform']), '{date}', 'date'" if date else "")


@query(" UNION ALL ".join(_roles_sql(*x) for x in INFERRED))
def column_roles(spark, sf):
    rows = [
        (table, side, c, role)
        for table, *_ in INFERRED
        for side in ("source", "platform")
        for c, role in autodetect.classify_columns(_t(spark, sf, table), side == "platform").items()
    ]
    return spark.createDataFrame(rows, "table string, side string, column string, role string")


_MAPPED = [
    ("o_orderdate", "o_orderdate", "exact", 1.0), ("o_custkey", "O_CUSTKEY", "exact", 0.95), ("o_totalprice", "o.totalprice", "normalized", 0.8),
    ("o_orderstatus", None, "none", 0.0), ("o_orderkey", None, "none", 0.0), ("o_orderpriority", "O_Orderpriority", "exact", 0.95),
]


@query(" UNION ALL ".join(
    f"SELECT '{s}' AS source, {repr(p) if p else 'NULL'} AS platform, '{c}' AS confidence, {x}::DOUBLE AS score, "
    f"{f'count({s})' if p else '0'} AS filled, {f'count(DISTINCT {s})' if p else '0'} AS differ FROM orders WHERE o_orderkey % 7 <> 0 HAVING count(*) > 0"
    for s, p, c, x in _MAPPED
))
def mapped_columns(spark, sf):
    """Columns of ``orders`` mapped to those of a renamed copy, and what the copy's
    columns hold under the source's names."""
    orders = _t(spark, sf, "orders")
    names = {"o_custkey": "O_CUSTKEY", "o_totalprice": "o.totalprice", "o_orderpriority": "O_Orderpriority", "o_orderstatus": "status"}
    copy = orders.where("o_orderkey % 7 <> 0").drop("o_orderkey").withColumnsRenamed(names)
    found = autodetect.map_columns(orders.columns, copy.columns)
    renamed = copy.withColumnsRenamed(autodetect.renames(found))
    facts = [F.struct(F.lit(m.source).alias("source"), F.lit(m.platform).alias("platform"), F.lit(m.confidence).alias("confidence"), F.lit(m.score).alias("score"),
                      (F.count(m.source) if m.platform else F.lit(0)).cast("long").alias("filled"),
                      (F.count_distinct(m.source) if m.platform else F.lit(0)).cast("long").alias("differ")) for m in found]
    return renamed.agg(F.array(*facts).alias("rows")).select(F.inline("rows"))


LABELLED = {"orders": (["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"]),
            "customer": (["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"], []),
            "events": (["event_type", "props"], ["event_id", "user_id", "value"], ["ts"])}


def _labels_sql(table: str) -> str:
    texts, numbers_, days = LABELLED[table]
    n = "count(DISTINCT {})"
    rows = [f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", CASE WHEN {n.format(c)} <= 50 THEN 'category (' ELSE 'text (' END || {n.format(c)} || ' values)' AS label FROM {table}" for c in texts]
    rows += [f"SELECT '{table}', '{c}', '{label}' FROM {table} HAVING count(*) > 0" for label, cs in (("number", numbers_), ("date", days)) for c in cs]
    return " UNION ALL ".join(rows)


@query(" UNION ALL ".join(map(_labels_sql, LABELLED)))
def column_labels(spark, sf):
    """What the columns of three tables hold, in words."""
    rows = [(t, c, x) for t in LABELLED for c, x in autodetect.type_labels(_t(spark, sf, t)).items()]
    return spark.createDataFrame(rows, "table string, column string, label string")


# A whole comparison.


@query(f"""WITH s AS ({MONTHLY}), {PUBLISHED}, q AS (SELECT "Date", "Key", v * 1000 AS v FROM p),
j AS (SELECT abs(q.v - s.v * 1000) AS a, abs(q.v - s.v * 1000) / greatest(abs(s.v * 1000), 1e-10) * 100 AS r FROM s JOIN q USING ("Date", "Key"))
SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM q) AS platform_rows, count(*) AS joined_rows,
  count(*) FILTER (a <= 0.01 OR r <= 1) AS matched, count(*) FILTER (a > 0.01 AND r > 1) AS different,
  round(count(*) FILTER (a <= 0.01 OR r <= 1) / count(*), 6) AS match_pct, round(avg(a), 2) AS mean_abs_diff, round(max(a), 2) AS max_abs_diff,
  round(avg(r), 4) AS mean_rel_diff_pct, round(max(r), 4) AS max_rel_diff_pct, 1000.0::DOUBLE AS scale_factor, 'high' AS confidence,
  (SELECT count(DISTINCT "Date") FROM s WHERE "Date" NOT IN (SELECT "Date" FROM q)) AS missing_dates,
  (SELECT count(DISTINCT "Date") FROM q WHERE "Date" NOT IN (SELECT "Date" FROM s)) AS extra_dates,
  (SELECT count(DISTINCT "Key") FROM s WHERE "Key" NOT IN (SELECT "Key" FROM q)) AS missing_keys,
  (SELECT count(DISTINCT "Key") FROM q WHERE "Key" NOT IN (SELECT "Key" FROM s)) AS extra_keys,
  least(20, count(*))::BIGINT AS top_diffs, 'Date>date,Key>KEY,Value>value' AS mapping FROM j""")
def compare_report(spark, sf):
    """Monthly orders and their publication in thousandths under other names."""
    source = _monthly(spark, sf)
    platform = _published(source, 1000.0).select(F.col("Key").alias("KEY"), F.col("Value").alias("value"), F.col("Date").alias("date"))
    side = {"date_column": "Date", "key_columns": ["Key"], "value_column": "Value"}
    r = compare.compare_datasets(source, platform, {"source": side, "tolerance": 0.01})
    counts = {k: getattr(r, k) for k in ("source_rows", "platform_rows", "joined_rows", "matched", "different")}
    shares = {"match_pct": round(r.match_pct, 6), "mean_abs_diff": round(r.mean_abs_diff, 2), "max_abs_diff": round(r.max_abs_diff, 2)}
    shares |= {"mean_rel_diff_pct": round(r.mean_rel_diff_pct, 4), "max_rel_diff_pct": round(r.max_rel_diff_pct, 4), "scale_factor": r.scale["scale_factor"]}
    cover = {f"{a}_{b}": r.coverage[f"{a}_{b}"] for b in ("dates", "keys") for a in ("missing", "extra")}
    texts = {"confidence": r.scale["confidence"], "mapping": ",".join(f"{m['source']}>{m['platform']}" for m in r.column_mapping)}
    row = counts | shares | cover | {"top_diffs": len(r.top_diffs)} | texts
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


# Sheets.


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS d, o_orderpriority AS p, sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS v FROM orders GROUP BY 1, 2)
SELECT d::TIMESTAMP AS "Date", lower(p) AS "Key", CASE month(d) WHEN 2 THEN 7.5 WHEN 3 THEN NULL ELSE round(v, 2) END AS "Value" FROM m""", "Date")
def canonicalize_sheet(spark, sf):
    """A sheet with title rows, a header row, a footer, day-first dates, European
    numbers, null texts and repeated keys."""
    m = _monthly(spark, sf)
    month = F.month("Date")
    text = F.translate(F.format_number(F.round("Value", 2), 2), ",.", ".,")
    place = (F.year("Date") * 12 + month) * 20 + F.substring("Key", 1, 1).cast("int") * 2
    rows = m.select(
        F.date_format("Date", "d/M/yyyy").alias("0"), F.concat(F.lit(" "), F.upper("Key")).alias("1"),
        F.when(month == 3, "n/a").otherwise(text).alias("2"), place.cast("long").alias("_ord"),
    )
    again = rows.where(F.element_at(F.split("0", "/"), 2) == "2").select("0", "1", F.lit("(7,50)").alias("2"), (F.col("_ord") + 1).alias("_ord"))
    again = again.withColumn("2", F.regexp_replace("2", r"[()]", ""))
    edges = [("Informe mensual", None, None, 0), (None, None, None, 1), ("Fecha", "Rubro", "Monto", 2), ("Total", "", "1,00", 10**9), ("Fuente: propia", None, None, 10**9 + 1)]
    sheet = rows.unionAll(again).unionAll(spark.createDataFrame(edges, rows.schema))
    side = {"header_row": 2, "skip_rows_bottom": 2, "date_column": "Fecha", "key_columns": ["Rubro"], "value_column": "Monto"}
    return canonicalize(sheet, side, "_ord").df.withColumn("Value", _r("Value", 2))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m_num, date_trunc('month', o_orderdate)::DATE AS m_es, date_trunc('month', o_orderdate)::DATE AS m_en,
  date_trunc('quarter', o_orderdate)::DATE AS q_num, date_trunc('quarter', o_orderdate)::DATE AS q_q, date_trunc('quarter', o_orderdate)::DATE AS q_t,
  CASE WHEN quarter(o_orderdate) < 4 AND o_orderkey % 7 <> 0 THEN make_date(year(o_orderdate), quarter(o_orderdate) * 3 + 1, 1) END AS odd FROM orders""",
       "m_num", "m_es", "m_en", "q_num", "q_q", "q_t", "odd")
def compose_dates(spark, sf):
    """Years and periods in six encodings; quarter 5 and unreadable years are null."""
    d = F.col("o_orderdate")
    es, en = (F.element_at(F.array(*[F.lit(x) for x in names]), F.month(d)) for names in (dates.MONTHS_ES, dates.MONTHS_EN))
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year(d).cast("string")).otherwise(F.concat(F.year(d), F.lit(".0")))
    quarter = F.quarter(d).cast("string")
    texts = _t(spark, sf, "orders").select(
        "o_orderkey", year.alias("year"), F.month(d).cast("double").cast("string").alias("m_num"), F.initcap(es).alias("m_es"),
        F.upper(F.substring(en, 1, 3)).alias("m_en"), quarter.alias("q_num"), F.concat(F.lit("q"), quarter).alias("q_q"),
        F.concat(quarter, F.lit("T")).alias("q_t"), (F.quarter(d) + 1).cast("string").alias("odd"),
        F.when(F.col("o_orderkey") % 7 == 0, "year?").otherwise(year).alias("odd_year"),
    )
    kinds = {"m_num": "month_numeric", "m_es": "month_text_es", "m_en": "month_text_en", "q_num": "quarter_numeric", "q_q": "quarter_text_q", "q_t": "quarter_text_t"}
    read = [dates.compose_date(F.col("year"), F.col(c), kind).cast("date").alias(c) for c, kind in kinds.items()]
    return texts.select("o_orderkey", *read, dates.compose_date(F.col("odd_year"), F.col("odd"), "quarter_numeric").cast("date").alias("odd"))


@query("""SELECT * FROM (VALUES ('m_num', 'month_numeric'), ('m_es', 'month_text_es'), ('m_en', 'month_text_en'), ('q_num', 'quarter_numeric'),
  ('q_q', 'quarter_text_q'), ('q_t', 'quarter_text_t')) AS v("column", encoding)""")
def period_encodings(spark, sf):
    d = F.col("o_orderdate")
    es, en = (F.element_at(F.array(*[F.lit(x) for x in names]), F.month(d)) for names in (dates.MONTHS_ES, dates.MONTHS_EN))
    q = F.quarter(d).cast("string")
    columns = {"m_num": F.month(d), "m_es": es, "m_en": F.initcap(en), "q_num": q, "q_q": F.concat(F.lit("Q"), q), "q_t": F.concat(q, F.lit("t"))}
    frame = _t(spark, sf, "orders").select(*[c.alias(k) for k, c in columns.items()])
    return spark.createDataFrame([(k, dates.detect_period_encoding(frame, k)) for k in columns], "column string, encoding string")


#: Texts that no reader may stumble over: (text, its format, its day where its own reader reads it).
ODD_DATES = [
    ("31/02/2024", "dmy", None), ("29.2.2024", "dmy", "2024-02-29"), (" 5-6-2024 ", "dmy", "2024-06-05"), ("12/25/2024", "dmy", None),
    ("2024-13-01", "iso", None), ("2024/02/30", "iso", None), ("2024/03/05", "iso", "2024-03-05"), ("2024-03-05 23:59", "timestamp", "2024-03-05"),
    ("2020-W53", "iso_week", "2020-12-28"), ("2021-W53", "iso_week", None), ("2021-W00", "iso_week", None), ("2023-24", "campaign_year_span", "2023-01-01"),
    ("1999/00", "campaign_year_span", "1999-01-01"), ("2023/2025", "campaign_year_span", None), ("2024-07", "year_month", "2024-07-01"), ("1987", "year_only", "1987-01-01"),
    ("q3 2021", "quarterly_q_year", "2021-07-01"), ("2021_Q4", "quarterly_year_q", "2021-10-01"), ("2T2020", "quarterly_t_year", "2020-04-01"), ("2020-T1", "quarterly_year_t", "2020-01-01"),
    ("ENE-24", "month_text_es_short", "2024-01-01"), ("Septiembre 2023", "month_text_es", "2023-09-01"), ("aug-19", "month_text_en_short", "2019-08-01"), ("December 2001", "month_text_en", "2001-12-01"),
    ("Q5 2021", None, None), ("5T2020", None, None), ("yesterday", None, None), ("", None, None), ("2024-3-5-7", None, None),
]


def _values(rows: list[tuple]) -> str:
    literal = lambda x: "NULL" if x is None else repr(x) if isinstance(x, int | float) else f"'{x}'"
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def _texts_of_orders(spark, sf, texts: list[str | None]) -> DataFrame:
    """A text for each order, by its key."""
    at = F.array(*[F.lit(x).cast("string") for x in texts])
    return _t(spark, sf, "orders").select("o_orderkey", F.get(at, (F.col("o_orderkey") % len(texts)).cast("int")).alias("text"))


@query(f"""SELECT o_orderkey, f AS format, d AS day FROM orders JOIN (VALUES {_values([(i, *r) for i, r in enumerate(ODD_DATES)])}) AS v(i, t, f, d)
  ON o_orderkey % {len(ODD_DATES)} = i""")
def odd_date_texts(spark, sf):
    """The format of each text, and what the reader of that format makes of it."""
    rows = _texts_of_orders(spark, sf, [t for t, *_ in ODD_DATES]).withColumn("format", dates.format_votes(F.col("text")))
    read = F.lit(None).cast("timestamp_ntz")
    for name in dates.FORMATS:
        read = F.when(F.col("format") == name, dates.parse_date(F.col("text"), name)).otherwise(read)
    return rows.select("o_orderkey", "format", F.date_format(read, "yyyy-MM-dd").alias("day"))


#: (text, value with a comma for decimals, value with a dot).
ODD_NUMBERS = [
    ("1.234,56", 1234.56, 1.23456), ("1,234.56", 1.23456, 1234.56), ("(500)", -500.0, -500.0), ("(1.000,5)", -1000.5, -1.0005), ("12,5%", None, None),
    ("AR$ 5", 5.0, 5.0), ("USD 7,25", 7.25, 725.0), ("€ -3", -3.0, -3.0), ("+4", 4.0, 4.0), (" 8 ", 8.0, 8.0), ("1 000", 1000.0, 1000.0),
    ("n/a", None, None), ("", None, None), ("--", None, None), ("abc", None, None), ("1,2,3", None, 123.0), ("5-", None, None), (None, None, None), ("2e3", 2000.0, 2000.0),
]


@query(f"""SELECT o_orderkey, a::DOUBLE AS comma, b::DOUBLE AS dot FROM orders JOIN (VALUES {_values([(i, *r[1:]) for i, r in enumerate(ODD_NUMBERS)])}) AS v(i, a, b)
  ON o_orderkey % {len(ODD_NUMBERS)} = i""")
def odd_number_texts(spark, sf):
    rows = _texts_of_orders(spark, sf, [t for t, *_ in ODD_NUMBERS])
    return rows.select(
        "o_orderkey",
        numbers.parse_number(F.col("text"), numbers.NumberFormat(",", ".")).alias("comma"),
        numbers.parse_number(F.col("text"), numbers.NumberFormat(".", ",")).alias("dot"),
    )


@query("""SELECT unnest(generate_series(DATE '2024-01-01', (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day
  EXCEPT SELECT ts::DATE FROM events WHERE day(ts) % 5 <> 0 OR isodow(ts) > 5 OR day(ts) IN (1, 30)""", "day")
def t2_gaps_business(spark, sf):
    """Business days without rows, holidays left out."""
    events = _t(spark, sf, "events").where((F.dayofmonth("ts") % 5 != 0) | (F.dayofmonth("ts") == F.lit(30)))
    whole = _t(spark, sf, "events").agg(F.max("ts").alias("ts")).unionAll(events.select("ts"))
    return K.gaps(K.date_index(whole, "ts"), "B", "AR")


# Series.


@query(f"SELECT event_type AS series_name, day::TIMESTAMP AS date, round(value, 4) AS value FROM ({DAILY})", "date")
def extract_transposed_series(spark, sf):
    """Days in the headers, a row for each event type."""
    days = _daily(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    sheet = days.groupBy("event_type").pivot("day").agg(F.first("value"))
    return series.extract_transposed(sheet, "event_type").points.select("series_name", "date", _r("value").alias("value"))


@query("""SELECT event_type || ' | ' || m AS series_name, count(*) AS row_count, round(avg(x), 4) AS mean, max(d) AS max_date FROM (
  SELECT event_type, ts::DATE::TIMESTAMP AS d, unnest(['value', 'user_id']) AS m, unnest([value, user_id::DOUBLE]) AS x FROM events) GROUP BY 1""", "max_date")
def extract_multi_series(spark, sf):
    events = _t(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value", "user_id")
    meta = series.extract_long_multi(events, "day", ["event_type"], ["value", "user_id"]).meta()
    return meta.select("series_name", "row_count", _r("mean").alias("mean"), "max_date")


@query("""SELECT event_type AS series_name, CASE event_type WHEN 'click' THEN 'no data' WHEN 'error' THEN 'one point' WHEN 'signup' THEN 'constant' END AS reason
FROM (SELECT DISTINCT event_type FROM events)""")
def discarded_series(spark, sf):
    """Series that can't be compared: one emptied, one cut to a point, one level."""
    events = _t(spark, sf, "events")
    first = events.where("event_type = 'error'").agg(F.min("event_id").alias("first"))
    kind, one = F.col("event_type"), F.col("event_id") == F.col("first")
    value = F.when(kind == "click", None).when((kind == "error") & ~one, None).when(kind == "signup", 5.0).otherwise(F.col("value"))
    points = events.crossJoin(F.broadcast(first)).select(kind.alias("series_name"), value.alias("value"))  # one row
    return series.discard_reasons(points)


NAMES = """SELECT n_name AS s, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, '_', '-') ELSE n_name || ' total' END AS p,
  CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.5 ELSE 0.4 END::DOUBLE AS c FROM nation"""


def _named(spark, sf):
    """Series of one point, so that their names alone can match them."""
    kind, name = F.col("n_nationkey") % 4, F.col("n_name")
    other = F.when(kind == 0, name).when(kind == 1, F.lower(name)).when(kind == 2, F.replace(name, F.lit("_"), F.lit("-"))).otherwise(F.concat(name, F.lit(" total")))
    point = [F.lit("2024-01-01").cast("timestamp_ntz").alias("date"), F.lit(1.0).alias("value")]
    nations = _t(spark, sf, "nation")
    return series.match_series(*[nations.select(n.alias("series_name"), *point) for n in (name, other)])


@query(f"SELECT s AS source, p AS platform, 'name_only' AS match_type, c AS confidence FROM ({NAMES})")
def series_name_match(spark, sf):
    return _named(spark, sf).to_frame(spark).drop("detail")


@query(f"""WITH n AS ({NAMES}), t AS (SELECT count(*) - 2 AS k, count(*) AS n FROM n)
SELECT s AS source, p AS platform, 'name_only' AS kind FROM n WHERE s NOT IN ('NATION_0', 'NATION_4', 'NATION_8')
UNION ALL SELECT 'NATION_0', 'NATION_4', 'manual' UNION ALL SELECT unnest(['NATION_4', 'NATION_8']), NULL, 'unmatched'
UNION ALL SELECT NULL, unnest(['NATION_0', 'NATION_8']), 'unmatched'
UNION ALL SELECT NULL, NULL, 'rate ' || round(k / n, 4)::VARCHAR FROM t""")
def series_manual_match(spark, sf):
    """A pair set by hand, a pair taken back, and what is left over."""
    changed = series.apply_manual(_named(spark, sf), [("NATION_0", "NATION_4"), ("nobody", "NATION_12")])
    changed = series.drop_matches(changed, ["NATION_8"])
    rows = [(m.source, m.platform, m.match_type) for m in changed.matches]
    rows += [(s, None, "unmatched") for s in changed.unmatched_source] + [(None, p, "unmatched") for p in changed.unmatched_platform]
    rows.append((None, None, f"rate {round(changed.summary()['match_rate_source'], 4)}"))
    return spark.createDataFrame(rows, "source string, platform string, kind string")


@query(f"SELECT n AS source, 'pub_' || n AS platform, CASE WHEN n < '3' THEN 'first' ELSE 'second' END AS file FROM (SELECT DISTINCT o_orderpriority AS n FROM orders)")
def series_merged_match(spark, sf):
    """Series of two source files matched with one publication, one after the other."""
    points = (
        _t(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("date"), F.col("o_orderpriority").alias("series_name"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("value"))
    )
    other = points.withColumns({"series_name": F.concat(F.lit("pub_"), "series_name"), "value": F.col("value") * 3 + 1})
    low = F.col("series_name") < "3"
    first = series.match_series(points.where(low), other)
    left = other.where(F.col("series_name").isin(first.unmatched_platform))
    merged = series.merge_matchings(first, series.match_series(points.where(~low), left))
    done = {m.platform for m in first.matches}
    rows = [(m.source, m.platform, "first" if m.platform in done else "second") for m in merged.matches]
    return spark.createDataFrame(rows, "source string, platform string, file string")


@query("""SELECT event_type AS series_name, count(*) AS row_count, round(min(value), 4) AS min, round(max(value), 4) AS max, min(ts::DATE)::TIMESTAMP AS min_date
FROM events WHERE value IS NOT NULL GROUP BY 1""", "min_date")
def extract_auto_series(spark, sf):
    """Series of a table whose columns tell their own roles."""
    events = _t(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type", "value")
    meta = series.extract_auto(events).meta()
    return meta.select("series_name", "row_count", _r("min").alias("min"), _r("max").alias("max"), "min_date")


@query("""WITH d AS (SELECT l_shipdate::DATE AS day, l_returnflag AS f, sum(l_quantity::DECIMAL(20,2))::DOUBLE AS q, sum(l_tax::DECIMAL(20,4))::DOUBLE AS t FROM lineitem GROUP BY 1, 2)
SELECT day::TIMESTAMP AS "Date", lower(f) || '|quantity' AS "Key", round(q * 10, 4) AS "Value" FROM d UNION ALL SELECT day::TIMESTAMP, lower(f) || '|tax', round(t * 10, 4) FROM d""", "Date")
def canonicalize_wide(spark, sf):
    """A wide table with a dimension, melted to dates, keys and scaled values."""
    daily = _t(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("decimal(20,2)")).cast("double").alias("quantity"), F.sum(F.col("l_tax").cast("decimal(20,4)")).cast("double").alias("tax")
    )
    side = {"date_column": "day", "key_columns": ["l_returnflag"], "value_columns": ["quantity", "tax"], "format": "wide", "scale": 10}
    return canonicalize(daily, side).df.withColumn("Value", _r("Value"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT o_orderkey, round(abs(v / b - 1), 4) AS change FROM c WHERE b IS NOT NULL AND abs(v / b - 1) > 5""")
def a2_pct_change_all(spark, sf):
    """Changes from order to order, over the whole table as one group."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    changed = K.pct_changes(orders, "o_totalprice", [], "o_orderdate", "o_orderkey")
    return changed.where("change > 5").select("o_orderkey", _r("change").alias("change"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(median(l_extendedprice), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY 1, 2""")
def grouped_medians(spark, sf):
    """Exact percentiles of groups that hold most of a table."""
    found = quantiles.grouped_percentiles(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), [0.1, 0.5, 0.999])
    return found.select("l_returnflag", "l_linestatus", *[_r(f"p{i}").alias(n) for i, n in enumerate(("p10", "p50", "p999"))])
