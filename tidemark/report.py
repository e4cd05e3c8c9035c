"""Reports for people and files: console, JSON, HTML, YAML."""

from __future__ import annotations

import html
import json
from dataclasses import asdict
from pathlib import Path
from typing import Any

import yaml

from tidemark.model import BLOCKER, INFO, WARNING, AuditReport, DiffReport
from tidemark.operators.series import Match, Matching

COLOURS = {BLOCKER: "\033[91m", WARNING: "\033[93m", INFO: "\033[94m", "ok": "\033[92m"}
PLAIN = "\033[0m"
SHOWN_DETAILS, SHOWN_ITEMS = 3, 5


def exit_code(report: AuditReport) -> int:
    return 2 if report.blockers else 1 if report.warnings else 0


def _short(x: Any) -> str:
    if isinstance(x, list) and len(x) > SHOWN_ITEMS:
        return f"{x[:SHOWN_ITEMS]} and {len(x) - SHOWN_ITEMS} more"
    return str(x)


def render_console(report: AuditReport, colour: bool = True) -> str:
    lines = [f"Audit of {report.dataset_name} at {report.timestamp}", report.summary]
    for category in dict.fromkeys(c.category for c in report.checks):
        lines.append(f"\n{category.upper()}")
        for c in (c for c in report.checks if c.category == category):
            mark = "ok" if c.passed else c.severity
            on, off = (COLOURS[mark], PLAIN) if colour else ("", "")
            lines.append(f"  {on}{mark:8}{off} {c.check_id} {c.check_name}: {c.message}")
            if not c.passed:
                lines += [f"      {k}: {_short(v)}" for k, v in list(c.details.items())[:SHOWN_DETAILS]]
                lines += [f"      -> {c.recommendation}"] if c.recommendation else []
    return "\n".join(lines)


def write_json(report: AuditReport | DiffReport, path: str | Path) -> None:
    data = asdict(report) if isinstance(report, AuditReport) else report.to_serializable_dict()
    Path(path).write_text(json.dumps(data, default=str, ensure_ascii=False, indent=2), encoding="utf-8")


def filter_checks(report: AuditReport, severities: list[str] | None = None, categories: list[str] | None = None) -> list:
    return [c for c in report.checks if (not severities or c.severity in severities) and (not categories or c.category in categories)]


def render_html(report: DiffReport) -> str:
    share = report.match_pct * 100
    colour = "#1a7f37" if share >= 95 else "#bf8700" if share >= 80 else "#cf222e"
    rows = report.top_diffs[:20]
    names = list(rows[0]) if rows else []
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    return (
        f"<html><head><meta charset='utf-8'><title>{html.escape(report.source_name)} and {html.escape(report.platform_name)}</title></head>"
        f"<body><h1 style='color:{colour}'>{share:.2f}% match</h1><p>{report.matched} of {report.joined_rows} pairs</p>"
        f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>"
    )


def save_matching(matching: Matching, path: str | Path, tolerance: float = 0.01) -> None:
    rows = [{"source": m.source, "platform": m.platform, "type": m.match_type, "confidence": m.confidence} for m in matching.matches]
    Path(path).write_text(yaml.safe_dump({"tolerance": tolerance, "matches": rows}, sort_keys=False, allow_unicode=True), encoding="utf-8")


def load_matching(path: str | Path, sources: list[str], platforms: list[str]) -> tuple[Matching, float]:
    """A saved matching applied to the series there are now."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    known = [r for r in data.get("matches", []) if r["source"] in sources and r["platform"] in platforms]
    matches = [Match(r["source"], r["platform"], r.get("type", "manual"), r.get("confidence", 1.0), "from a file") for r in known]
    used = {m.source for m in matches}, {m.platform for m in matches}
    return Matching(matches, [s for s in sources if s not in used[0]], [p for p in platforms if p not in used[1]]), data.get("tolerance", 0.01)
