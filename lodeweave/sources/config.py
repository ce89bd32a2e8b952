"""Settings from a TOML text, tolerant of errors: a bad value becomes a problem, not a failure."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from ..schema import CATEGORIES, CONFIDENCE

#: Fewest tokens of a duplicate function that may be asked for.
LEAST_TOKENS = 50

#: What `init` writes.
TEMPLATE = """[analysis]
skip = []
min-confidence = "possible"

[analysis.duplicate]
min-tokens = 50

[analysis.crap]
threshold = 30.0

[plugins]
max-age = "7d"

[delta]
# unused = 0
"""


@dataclass
class Settings:
    skip: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    min_confidence: int = 0
    duplicate_tokens: int = LEAST_TOKENS
    crap_threshold: float = 30.0
    fail_on: int | None = None
    rules_off: list[str] = field(default_factory=list)
    externally_invoked: list[tuple[list[str], str]] = field(default_factory=list)
    budgets: dict[str, int] = field(default_factory=dict)
    coverage_reports: list[str] = field(default_factory=list)
    max_age_seconds: int = 7 * 86_400
    problems: list[str] = field(default_factory=list)


def seconds(text: str) -> int:
    """`7d`, `24h`, `30m`, `10s`."""
    m = re.fullmatch(r"(\d+)\s*([smhd])", text.strip())
    if not m:
        raise ValueError(f"{text!r} is no duration")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[m[2]]


def parse(text: str) -> Settings:
    out = Settings()
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        out.problems.append(str(error))
        return out

    def take(section: dict, key: str, kind: type | tuple, where: str):
        value = section.get(key)
        if value is not None and not isinstance(value, kind):
            out.problems.append(f"{where}.{key}: {value!r} is not usable")
            return None
        return value

    analysis = data.get("analysis", {})
    for name in take(analysis, "skip", list, "analysis") or []:
        out.skip.append(name) if name in CATEGORIES else out.problems.append(f"analysis.skip: unknown category {name!r}")
    if (level := take(analysis, "min-confidence", str, "analysis")) is not None:
        if level in CONFIDENCE:
            out.min_confidence = CONFIDENCE.index(level)
        else:
            out.problems.append(f"analysis.min-confidence: {level!r} is not usable")
    if (tokens := take(analysis.get("duplicate", {}), "min-tokens", int, "analysis.duplicate")) is not None:
        out.duplicate_tokens = max(tokens, LEAST_TOKENS)
    if (threshold := take(analysis.get("crap", {}), "threshold", (int, float), "analysis.crap")) is not None:
        out.crap_threshold = float(threshold)
    out.rules_off = [k for k, v in data.get("rule", {}).items() if v in (False, "off")]
    for rule in data.get("externally-invoked", []):
        if isinstance(rule.get("markers"), list) and isinstance(rule.get("files", "**"), str):
            out.externally_invoked.append((rule["markers"], rule.get("files", "**")))
        else:
            out.problems.append(f"externally-invoked: {rule!r} is not usable")
    for name, most in data.get("delta", {}).items():
        if isinstance(most, int) and not isinstance(most, bool):
            out.budgets[name] = most
        else:
            out.problems.append(f"delta.{name}: {most!r} is not usable")
    plugins = data.get("plugins", {})
    out.coverage_reports = take(plugins, "report", list, "plugins") or []
    if (age := take(plugins, "max-age", str, "plugins")) is not None:
        try:
            out.max_age_seconds = seconds(age)
        except ValueError as error:
            out.problems.append(f"plugins.max-age: {error}")
    known = {"analysis", "rule", "externally-invoked", "plugins", "delta", "performance"}
    out.problems += [f"unknown table {k!r}" for k in data if k not in known]
    return out


def merge(file: Settings, flags: Settings) -> Settings:
    """Flags over the file over defaults; what is skipped adds up."""
    out = Settings(**{k: getattr(flags, k) if getattr(flags, k) != getattr(Settings(), k) else getattr(file, k) for k in Settings.__dataclass_fields__})
    out.skip = sorted({*file.skip, *file.rules_off, *flags.skip})
    return out
