"""The audit: facts of a table turned into a severity-ranked report.

The table is read once: that pass writes the date, the dimensions, the value, the
order and a 128-bit hash of each row as a slim table in the shared folder, and all
scalar facts are observed on the way. Every further check reads columns of the
slim table; the table itself is read again only to confirm rows whose hash
repeats. The slim table is deleted with the report's end. Only aggregates and the
few rows of samples reach the driver.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import config_from_dict
from tidemark.functions import calendars, dates
from tidemark.functions.numbers import is_numeric
from tidemark.model import BLOCKER, INFO, WARNING, AuditReport, CheckResult
from tidemark.operators import checks as K
from tidemark.operators import shape
from tidemark.operators.quantiles import exact_percentiles
from tidemark.shared import scratch_tables
from tidemark.sources.readers import nan_to_null, with_order

ORDER = "_ord"
SAMPLE_GAPS, SAMPLE_KEYS, SAMPLE_DIMS, SAMPLE_Z = 20, 5, 10, 3


def _plain(x: Any) -> Any:
    return x.isoformat() if isinstance(x, dt.date | dt.datetime) else x


def _date_text(x: Any) -> str | None:
    return None if x is None else x.strftime("%Y-%m-%d")


class Audit:
    """One table under one config; ``run()`` gives the report."""

    def __init__(
        self,
        df: DataFrame,
        config: dict[str, Any],
        snapshot: DataFrame | None = None,
        as_of: dt.date | None = None,
        order: str | None = None,
    ):
        self.settings = config_from_dict(config)
        self.as_of = as_of or dt.date.today()
        self.raw_columns, self.raw_kinds = df.columns, dict(df.dtypes)
        self.rows, self.config = self._prepare(df, order)
        self.before = self._prepare(snapshot, order)[0] if snapshot is not None else None
        self.columns = [c for c in self.rows.columns if c != ORDER]
        self.date = self.config["date_column"] if self.config["date_column"] in self.columns else None
        self.dims = shape.dimension_columns(self.columns, self.config)
        self.value = next(iter(shape.value_columns(self.columns, self.config)), None)

    def _prepare(self, df: DataFrame, order: str | None) -> tuple[DataFrame, dict]:
        """Long format with parsed dates and the order of rows; unpivoted rows
        keep the order of the rows they come from."""
        config = self.settings
        df = nan_to_null(df)
        df = df.withColumn(ORDER, F.col(order)) if order else with_order(df, ORDER)
        date = config["date_column"]
        if date in df.columns:
            df = df.withColumn(date, dates.parse_audit_date(df, date))
        if shape.detect_format(df.columns, config) == "wide":
            present = [c for c in config["value_columns"] if c in df.columns]
            if not present:  # nothing to unpivot: the schema check will say so
                return df, config
        return shape.to_long(df, config)

    # The one pass over the table.

    def _wanted(self, frame: DataFrame) -> list:
        if self.value and is_numeric(dict(frame.dtypes)[self.value]):
            return K.table_aggregates(frame, self.value, self.date, self.config["value_range"])
        kinds = dict(frame.dtypes)
        wanted = [F.count("*").alias("n_rows")]
        wanted += [F.count_if(K.missing(K.q(c), kinds[c])).alias(f"null:{c}") for c in self.columns]
        if self.date:
            wanted += [F.min(K.q(self.date)).alias("first_date"), F.max(K.q(self.date)).alias("last_date")]
        return wanted

    def _read(self, keep) -> dict[str, Any]:
        """Write the slim table and give the facts observed meanwhile."""
        seen = Observation()
        frame = self.rows.select(*[K.q(c) for c in self.columns], ORDER)
        h1, h2 = K.row_hashes(frame, self.columns)
        slim = dict.fromkeys(c for c in (self.date, *self.dims, self.value) if c)
        observed = frame.observe(seen, *self._wanted(frame.drop(ORDER)))
        self.slim = keep(observed.select(*map(K.q, slim), ORDER, h1.alias("h1"), h2.alias("h2")), "audited")
        return seen.get

    def run(self) -> AuditReport:
        with scratch_tables() as keep:
            self.keep = keep
            facts = self._read(keep)
            results = [*self.schema(), *self.temporal(facts), *self.integrity(facts), *self.statistics(facts), *self.consistency()]
        for r in results:
            r.severity = self._severity(r)
        return self._report(results)

    def _severity(self, r: CheckResult) -> str:
        over = self.config["severity_overrides"] or {}
        return over.get(r.check_id, over.get(f"{r.check_id}_{r.check_name}", r.severity))

    def _report(self, results: list[CheckResult]) -> AuditReport:
        failed = [r for r in results if not r.passed]
        n = {s: sum(r.severity == s for r in failed) for s in (BLOCKER, WARNING, INFO)}
        verdict = next(
            (text for s, text in ((BLOCKER, "FAILED"), (WARNING, "WARNINGS"), (INFO, "INFO")) if n[s]), "PASSED"
        )
        return AuditReport(
            dataset_name=self.config.get("dataset_name", ""),
            timestamp=dt.datetime.now(dt.UTC).isoformat(timespec="seconds"),
            total_checks=len(results),
            passed=len(results) - len(failed),
            blockers=n[BLOCKER],
            warnings=n[WARNING],
            infos=n[INFO],
            checks=results,
            summary=f"{verdict}: {n[BLOCKER]} blockers, {n[WARNING]} warnings, {n[INFO]} infos of {len(results)} checks",
        )

    # Schema.

    def schema(self) -> list[CheckResult]:
        s = self.settings
        wide = shape.detect_format(self.raw_columns, s) == "wide"
        needed = [s["date_column"], *s["dimension_columns"], *(s["value_columns"] if wide else [s["value_column"]])]
        lost = [c for c in needed if c not in self.raw_columns]
        present = [c for c in needed if c in self.raw_columns]
        out = [
            CheckResult(
                "S1", "required_columns_present", "schema", BLOCKER, not lost,
                f"missing columns: {lost}" if lost else "all required columns are there",
                {"missing": lost, "present": present}, "add the columns or correct the config" if lost else "",
            )
        ]
        wrong = {}
        if self.date and not self.raw_kinds[s["date_column"]].startswith(("date", "timestamp")):
            sample = self.slim.select(K.q(self.date)).limit(5).collect()
            if sample and all(r[0] is None for r in sample):
                wrong[self.date] = self.raw_kinds[s["date_column"]]
        for c in s["value_columns"] if wide else [s["value_column"]]:
            if c in self.raw_kinds and not is_numeric(self.raw_kinds[c]):
                wrong[c] = self.raw_kinds[c]
        out.append(
            CheckResult(
                "S2", "data_types", "schema", WARNING, not wrong,
                f"unexpected types: {wrong}" if wrong else "types are as expected", wrong,
                "convert these columns" if wrong else "",
            )
        )
        details: dict[str, Any] = {}
        for c, expected in (self.config["expected_dimensions"] or {}).items():
            if expected is None or c not in self.columns:
                continue
            place = F.row_number().over(W.partitionBy("status").orderBy("value"))
            diff = K.dimension_diff(self.slim, c, expected).withColumn("place", place).where(F.col("place") <= SAMPLE_DIMS)
            for r in diff.orderBy(F.desc("status"), "place").collect():
                details.setdefault(f"{c}_{r['status']}", []).append(r["value"])
        out.append(
            CheckResult(
                "S3", "dimension_values", "schema", WARNING, not details,
                "dimension values differ from the expected" if details else "dimension values are as expected", details,
            )
        )
        return out

    # Temporal.

    def temporal(self, facts: dict[str, Any]) -> list[CheckResult]:
        if not self.date or facts.get("last_date") is None:
            return []
        c = self.config
        days = K.date_index(self.slim, self.date).persist()
        try:
            return self._temporal(facts, c, days)
        finally:
            days.unpersist()

    def _temporal(self, facts, c, days) -> list[CheckResult]:
        expected, country = c["expected_frequency"], c["holidays_country"]
        f = K.frequency_facts(days).first()
        same = f["inferred"] == expected
        out = [
            CheckResult(
                "T1", "frequency_mismatch", "temporal", BLOCKER, same,
                f"frequency is {f['inferred']}, expected {expected}",
                {"inferred": f["inferred"], "expected": expected, "n_unique_dates": f["n_dates"]},
            )
        ]
        if f["n_dates"] < 2:
            out.append(CheckResult("T2", "gap_detection", "temporal", BLOCKER, False, "fewer than two dates"))
        else:
            lost = K.gaps(days, expected, country)
            n = lost.count()
            sample = [_date_text(r["day"]) for r in lost.orderBy("day").limit(SAMPLE_GAPS).collect()]
            out.append(
                CheckResult("T2", "gap_detection", "temporal", BLOCKER, n == 0, f"{n} expected dates are missing", {"gap_count": n, "gaps_sample": sample})
            )
        keys = [self.date, *self.dims]
        seen = Observation()
        double = K.duplicate_keys(self.slim, keys).observe(seen, F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        sample = [{k: str(_plain(r[k])) for k in keys} for r in double.orderBy(*map(K.q, keys)).limit(SAMPLE_KEYS).collect()]
        n = seen.get["n"]
        out.append(
            CheckResult("T3", "duplicate_date_dimension_keys", "temporal", BLOCKER, n == 0, f"{n} rows share a key", {"duplicate_rows": n, "sample": sample})
        )
        last, lag = facts["last_date"].date(), c["acceptable_lag_days"]
        stale = (self.as_of - dt.timedelta(days=lag) - last).days
        out.append(
            CheckResult(
                "T4", "staleness", "temporal", WARNING, stale <= 0, f"last date is {last}",
                {"last_date": str(last), "today": str(self.as_of), "acceptable_lag_days": lag, "days_stale": max(0, stale)},
            )
        )
        first = facts["first_date"].date()
        details, fine = {"actual_start": str(first), "actual_end": str(last)}, True
        for name, late in (("expected_start", lambda d: first > d), ("expected_end", lambda d: last < d)):
            if c[name]:
                details[name] = str(c[name])
                fine = fine and not late(dt.date.fromisoformat(str(c[name])[:10]))
        out.append(CheckResult("T5", "date_range_validation", "temporal", WARNING, fine, f"dates from {first} to {last}", details))
        histogram = {r["weekday"]: r["n"] for r in K.weekday_histogram(days).collect()}
        closed = calendars.holidays(country)
        on_holiday = days.where(F.col("day").isin(closed)).count() if closed else 0
        weekend = histogram.get(5, 0) + histogram.get(6, 0)
        odd = expected == "B" and (weekend > 0 or (bool(closed) and on_holiday > 0))
        out.append(
            CheckResult(
                "T6", "day_pattern_detection", "temporal", INFO, not odd, f"{weekend} weekend dates, {on_holiday} holiday dates",
                {"weekend_dates_count": weekend, "holiday_dates_count": on_holiday, "day_of_week_distribution": {str(k): v for k, v in sorted(histogram.items())}},
            )
        )
        return out

    # Integrity.

    def integrity(self, facts: dict[str, Any]) -> list[CheckResult]:
        c, n = self.config, facts["n_rows"]
        most = c["max_null_pct"]
        over = {x: round(facts[f"null:{x}"] / n, 4) for x in self.columns if n and facts[f"null:{x}"] / n > most}
        out = [
            CheckResult(
                "I1", "null_percentage", "integrity", WARNING, n > 0 and not over,
                "no rows" if not n else f"{len(over)} columns over {most:.1%} nulls", {"violating_columns": over, "threshold": most},
            )
        ]
        zeros = facts.get("zeros") or 0
        if c["allow_zero_values"]:
            out.append(CheckResult("I2", "suspicious_zeros", "integrity", WARNING, True, "zeros are allowed", {"skipped": True}))
        else:
            counts = {self.value: zeros} if zeros else {}
            out.append(CheckResult("I2", "suspicious_zeros", "integrity", WARNING, not zeros, f"{zeros} zeros", {"zero_counts": counts}))
        hashes = self.keep(K.repeated_hashes(self.slim), "repeated-hashes")
        again = 0 if hashes.isEmpty() else K.exact_duplicates(self.rows, self.columns, hashes).first()["exact_duplicate_count"]
        out.append(
            CheckResult("I3", "exact_duplicate_rows", "integrity", BLOCKER, again == 0, f"{again} repeated rows", {"exact_duplicate_count": again})
        )
        bounds = c["value_range"] or {}
        if (bounds.get("min") is None and bounds.get("max") is None) or "min" not in facts:
            out.append(CheckResult("I4", "value_range", "integrity", WARNING, True, "no range is set", {"skipped": True}))
            return out
        details = {f"{self.value}_actual_min": facts["min"], f"{self.value}_actual_max": facts["max"]}
        details |= {f"{self.value}_{k}_{m}": facts[k] for k, m in (("below", "min"), ("above", "max")) if facts[k]}
        fine = not facts["below"] and not facts["above"]
        out.append(CheckResult("I4", "value_range", "integrity", WARNING, fine, f"{facts['below']} below, {facts['above']} above", details))
        return out

    # Statistics.

    def statistics(self, facts: dict[str, Any]) -> list[CheckResult]:
        v, c, n = self.value, self.config, facts.get("count") or 0
        out = []
        if n < K.Z_MIN_VALUES:
            out.append(CheckResult("A1", "zscore_outliers", "statistical", WARNING, True, "too few values", {"skipped": True}))
        else:
            seen = Observation()
            wild = K.zscores(self.slim, v, self.dims).where(F.abs("z") > c["outlier_zscore_threshold"]).observe(seen, F.count("*").alias("n"))
            worst = wild.select("z").orderBy(F.desc(F.abs("z"))).limit(SAMPLE_Z).collect()
            count = seen.get["n"]
            details = {}
            if count:
                details = {v: {"count": count, "pct": round(count / facts["n_rows"], 4)}, f"{v}_worst_z": [round(r["z"], 2) for r in worst]}
            out.append(CheckResult("A1", "zscore_outliers", "statistical", WARNING, not count, f"{count} outliers", details))
        if not self.date or not n:
            out.append(CheckResult("A2", "abrupt_pct_change", "statistical", WARNING, True, "no dated values", {"skipped": True}))
        else:
            narrow = self.slim.select(*map(K.q, dict.fromkeys([self.date, *self.dims, v])), ORDER)
            jumps = K.pct_changes(narrow, v, self.dims, self.date, ORDER, keep=self.keep)
            got = jumps.where(F.col("change") > c["pct_change_threshold"]).agg(F.count("*").alias("n"), F.max("change").alias("m")).first()
            details = {v: {"count": got["n"], "max_pct_change": got["m"]}} if got["n"] else {}
            out.append(CheckResult("A2", "abrupt_pct_change", "statistical", WARNING, not got["n"], f"{got['n']} abrupt changes", details))
        details = {}
        if n:
            p = exact_percentiles(self.slim, K.q(v), [0.25, 0.5, 0.75])
            skew = facts["skew_pop"] * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and facts["skew_pop"] is not None else None
            numbers = {"mean": facts["mean"], "std": facts["std"], "min": facts["min"], "p25": p[0], "median": p[1], "p75": p[2], "max": facts["max"], "skew": skew}
            details = {v: {"count": n, **{k: None if x is None else round(x, 4) for k, x in numbers.items()}}}
        out.append(CheckResult("A3", "distribution_summary", "statistical", INFO, True, f"{n} values", details))
        return out

    # Consistency.

    def consistency(self) -> list[CheckResult]:
        names = [("C1", "historical_rewrites"), ("C2", "pct_cells_modified"), ("C3", "revision_whitelist")]
        whitelist = self.config["revision_whitelist"]
        if self.before is None:
            return [CheckResult(i, n, "consistency", INFO, True, "no snapshot", {"skipped": True}) for i, n in names]
        dims = [d for d in self.dims if d in self.before.columns]
        values = [v for v in [self.value] if v and v in self.before.columns]
        cutoff = self.as_of - dt.timedelta(days=whitelist["max_revision_age_days"])
        f = None
        if self.date and values and self.date in self.before.columns:
            index = [K.key_index(x, self.date, dims, values, ORDER) for x in (self.slim, self.before)]
            f = K.revision_facts(*index, dims, values, str(cutoff)).first()
        if f is None or not f["common_rows"]:
            return [CheckResult(i, n, "consistency", INFO, True, "nothing in common with the snapshot") for i, n in names]
        rows, changed = f["common_rows"], f["changed_rows"]
        cells, share = f["changed_cells"], f["changed_cells"] / f["total_cells"]
        most = whitelist["max_revision_pct"]
        out = [
            CheckResult(
                "C1", "historical_rewrites", "consistency", WARNING, not changed, f"{changed} of {rows} common rows changed",
                {"changed_rows": changed, "total_common_rows": rows, "pct_changed": round(changed / rows, 4)},
            ),
            CheckResult(
                "C2", "pct_cells_modified", "consistency", INFO, share <= most, f"{cells} cells changed",
                {"changed_cells": cells, "total_cells": f["total_cells"], "pct_changed": round(share, 4), "threshold": most},
            ),
        ]
        if not whitelist["enabled"]:
            out.append(CheckResult("C3", "revision_whitelist", "consistency", WARNING, True, "no whitelist is set", {"skipped": True}))
            return out
        old = f["old_revisions"]
        details = {
            "total_revised_rows": changed, "recent_revisions": changed - old, "old_revisions_beyond_age": old,
            "pct_revised": round(changed / rows, 4), "max_age_days": whitelist["max_revision_age_days"], "max_pct": most,
        }
        fine = not old and changed / rows <= most
        out.append(CheckResult("C3", "revision_whitelist", "consistency", WARNING, fine, f"{old} old revisions", details))
        return out


def audit_dataset(df: DataFrame, config: dict[str, Any], snapshot: DataFrame | None = None, as_of: dt.date | None = None, order: str | None = None) -> AuditReport:
    """Audit ``df``; ``order`` names the column that gives the order of rows."""
    return Audit(df, config, snapshot, as_of, order).run()
