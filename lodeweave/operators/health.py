"""The health score: weighted, saturating ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: axis: (weight, ratio at which the penalty is full). Fixed values.
AXES = {
    "unused-symbols": (25.0, 0.25),
    "unused-dependencies": (15.0, 0.5),
    "unused-files": (10.0, 0.25),
    "test-only": (10.0, 0.25),
    "duplication": (20.0, 0.3),
    "crap": (20.0, 0.5),
    "cycles": (5.0, 0.25),
    "internal-only": (5.0, 0.5),
    "untested": (5.0, 0.5),
}
#: Least score of each grade. Fixed values.
GRADES = (("A", 90), ("B", 80), ("C", 65), ("D", 50))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def to_next_grade(score: Column) -> Column:
    """Points that are missing to the next better grade; null for the best."""
    out = F.lit(None).cast("double")
    for _, least in GRADES:
        out = F.when(score < least, F.round(least - score, 1)).otherwise(out)
    return out


def penalties(ratios: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, axis, ratio, penalty) from (by, axis, part, whole): weight * min(ratio / saturation, 1), to one decimal.

    Axes that aren't there (abstained) cost nothing; an empty whole has ratio 0.
    """
    by = by or []
    weight = F.create_map(*[F.lit(x) for k, (w, _) in AXES.items() for x in (k, w)])
    full = F.create_map(*[F.lit(x) for k, (_, s) in AXES.items() for x in (k, s)])
    ratio = F.coalesce(F.try_divide(F.col("part").cast("double"), F.col("whole").cast("double")), F.lit(0.0))
    rows = ratios.where(F.col("axis").isin(*AXES)).withColumn("ratio", ratio)
    penalty = F.try_element_at(weight, F.col("axis")) * F.least(F.col("ratio") / F.try_element_at(full, F.col("axis")), F.lit(1.0))
    return rows.select(*by, "axis", "ratio", F.round(penalty, 1).alias("penalty"))


def score(penalized: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, grade): 100 less all penalties, 0 at least."""
    total = penalized.groupBy(*(by or [])).agg(F.round(F.greatest(F.lit(0.0), 100 - F.sum("penalty")), 1).alias("score"))
    return total.withColumn("grade", grade(F.col("score")))
