"""Audit settings: defaults, validation, YAML files."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

import yaml

#: The accepted names.
FREQUENCIES = ("D", "B", "W", "M", "Q", "A")
FORMATS = ("long", "wide")

#: The defaults that a config file may leave out.
DEFAULTS: dict[str, Any] = {
    "format": "long",
    "date_column": "Date",
    "dimension_columns": [],
    "value_column": "Value",
    "value_columns": [],
    "expected_frequency": "D",
    "expected_start": None,
    "expected_end": None,
    "acceptable_lag_days": 3,
    "holidays_country": None,
    "timezone": None,
    "expected_dimensions": {},
    "max_null_pct": 0.05,
    "allow_zero_values": True,
    "value_range": {"min": None, "max": None},
    "outlier_zscore_threshold": 3.5,
    "pct_change_threshold": 0.5,
    "revision_whitelist": {"enabled": False, "max_revision_age_days": 90, "max_revision_pct": 0.10},
    "severity_overrides": {},
}


class ConfigError(ValueError):
    """A setting that no audit can run with."""


def with_defaults(settings: dict[str, Any]) -> dict[str, Any]:
    """``settings`` over the defaults, nested ones key by key."""
    merged = copy.deepcopy(DEFAULTS)
    for key, value in settings.items():
        if isinstance(merged.get(key), dict) and isinstance(value, dict):
            merged[key] = {**merged[key], **value}
        else:
            merged[key] = value
    return merged


def validate(config: dict[str, Any]) -> dict[str, Any]:
    missing = [k for k in ("dataset_name", "date_column") if not config.get(k)]
    if missing:
        raise ConfigError(f"missing settings: {', '.join(missing)}")
    if config["format"] not in FORMATS:
        raise ConfigError(f"format is {config['format']!r}, not one of {FORMATS}")
    if config["format"] == "long" and not config.get("value_column"):
        raise ConfigError("long format needs value_column")
    if config["format"] == "wide" and not config.get("value_columns"):
        raise ConfigError("wide format needs value_columns")
    if config["expected_frequency"] not in FREQUENCIES:
        raise ConfigError(f"expected_frequency is {config['expected_frequency']!r}, not one of {FREQUENCIES}")
    return config


def load_config(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return validate(with_defaults(yaml.safe_load(f) or {}))


def config_from_dict(settings: dict[str, Any]) -> dict[str, Any]:
    """Defaults filled in, nothing validated."""
    return with_defaults(settings)


def save_config(config: dict[str, Any], path: str | Path) -> None:
    """YAML without the internal keys, which begin with an underscore."""
    public = {k: v for k, v in config.items() if not k.startswith("_")}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(public, f, sort_keys=False, allow_unicode=True)
