"""Suppression comments: `weave:allow <category>[:<subject>] [reason]`, or `allow-file` for a whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"(?:^|[^\w:-])weave:allow(-file)?[ \t]+([a-z-]+)(?::([^\s]+))?(?:[ \t]+(.*?))?[ \t]*(?:\*/|-->)?[ \t]*$"


def _group(line: Column, n: int) -> Column:
    value = F.regexp_extract(line, PATTERN, n)
    return F.when(value != "", value)


def parse(rows: DataFrame, line: str) -> DataFrame:
    """Rows with a pragma on `line`, with scope (file or next), category, subject and reason; null where not stated."""
    c = F.col(line)
    return rows.where(c.rlike(PATTERN)).withColumns({"scope": F.when(_group(c, 1).isNotNull(), "file").otherwise("next"), "category": _group(c, 2), "subject": _group(c, 3), "reason": _group(c, 4)})
