"""Reports as text: JSON envelope, SARIF, terse lines for agents, lines for people. Rows arrive in display order."""

from __future__ import annotations

import json
from collections.abc import Iterable

from ..schema import CONFIDENCE, GROUPS

LEVELS = {0: "note", 1: "warning", 2: "error"}
NAMES = {0: "info", 1: "warning", 2: "error"}


def json_report(findings: Iterable[dict], health: dict | None = None, mode: str = "full") -> str:
    rows = [{**f, "severity": NAMES[f["severity"]], "confidence": CONFIDENCE[f["confidence"]]} for f in findings]
    return json.dumps({"version": "1.0.0", "mode": mode, "findings": rows, "health": health}, ensure_ascii=False)


def sarif(findings: Iterable[dict]) -> str:
    rows = list(findings)
    rules = [{"id": c, "shortDescription": {"text": c}} for c in sorted({f["category"] for f in rows})]
    results = [
        {
            "ruleId": f["category"],
            "level": LEVELS[f["severity"]],
            "message": {"text": f["message"] or f"{f['category']}: {f['symbol'] or f['path']}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["path"]}, "region": {"startLine": max(1, f["line"])}}}],
            "partialFingerprints": {"findingId/v1": f["id"]},
        }
        for f in rows
    ]
    run = {"tool": {"driver": {"name": "lodeweave", "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def group_of(category: str) -> str:
    return next((g for g, cs in GROUPS.items() if category in cs), "other")


def agent_text(findings: Iterable[dict]) -> str:
    """One line per finding under a heading per category."""
    out, last = [], None
    for f in sorted(findings, key=lambda f: (-f["severity"], f["category"], f["path"], f["line"], f["id"])):
        if f["category"] != last:
            last = f["category"]
            out.append(f"## {last}")
        out.append(f"{f['path']}:{f['line']} {f['symbol'] or ''} [{f['id']} {CONFIDENCE[f['confidence']]}]".replace("  ", " "))
    return "\n".join(out)


def human_text(findings: Iterable[dict], score: dict | None = None) -> str:
    rows, out = list(findings), []
    for group in [*GROUPS, "other"]:
        own = [f for f in rows if group_of(f["category"]) == group]
        if own:
            out.append(f"{group} ({len(own)})")
            out += [f"  {NAMES[f['severity']]:7} {f['path']}:{f['line']}  {f['category']}: {f['symbol'] or f['subject_kind']}" + (f" ({f['message']})" if f["message"] else "") for f in own]
    if score:
        out.append(f"health {score['score']} {score['grade']}")
    return "\n".join(out or ["nothing found"])


FORMATS = {"json": json_report, "sarif": sarif, "agent": agent_text, "human": human_text}
