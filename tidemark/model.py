"""Results: small driver records; frames inside them stay lazy."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

BLOCKER, WARNING, INFO = "BLOCKER", "WARNING", "INFO"
SEVERITIES = (BLOCKER, WARNING, INFO)

CHECK_SCHEMA = (
    "check_id string, check_name string, category string, severity string, passed boolean, "
    "message string, details string, recommendation string"
)


@dataclass
class CheckResult:
    check_id: str
    check_name: str
    category: str
    severity: str
    passed: bool
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    recommendation: str = ""

    def __post_init__(self) -> None:
        self.passed = bool(self.passed)

    def row(self) -> tuple:
        d = asdict(self)
        return (*[d[k] for k in ("check_id", "check_name", "category", "severity", "passed", "message")],
                json.dumps(self.details, default=str, sort_keys=True), self.recommendation)


@dataclass
class AuditReport:
    dataset_name: str
    timestamp: str
    total_checks: int
    passed: int
    blockers: int
    warnings: int
    infos: int
    checks: list[CheckResult]
    summary: str

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([c.row() for c in self.checks], CHECK_SCHEMA)


@dataclass
class DiffReport:
    source_name: str
    platform_name: str
    tolerance: float
    source_rows: int = 0
    platform_rows: int = 0
    joined_rows: int = 0
    matched: int = 0
    different: int = 0
    match_pct: float = 0.0
    mean_abs_diff: float = 0.0
    max_abs_diff: float = 0.0
    mean_rel_diff_pct: float = 0.0
    max_rel_diff_pct: float = 0.0
    coverage: dict[str, Any] = field(default_factory=dict)
    scale: dict[str, Any] = field(default_factory=dict)
    temporal_shift: int | None = None
    top_diffs: list[dict[str, Any]] = field(default_factory=list)
    series_summary: list[dict[str, Any]] = field(default_factory=list)
    column_mapping: list[dict[str, Any]] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    all_diffs: DataFrame | None = None

    def to_serializable_dict(self) -> dict[str, Any]:
        """Everything but the frame; floats rounded to six places."""

        def plain(x):
            if isinstance(x, float):
                return round(x, 6)
            if isinstance(x, dict):
                return {str(k): plain(v) for k, v in x.items()}
            if isinstance(x, list | tuple):
                return [plain(v) for v in x]
            return x if isinstance(x, int | str | bool | type(None)) else str(x)

        return {k: plain(v) for k, v in self.__dict__.items() if k != "all_diffs"}
