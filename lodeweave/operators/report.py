"""The report: two-sided differences, baselines, suppressions, filters, budgets, gates, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CATEGORIES

META = "stale"


def touched_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path): files that were added, removed or changed. Both: (path, content_hash)."""
    b, a = before.select("path", F.col("content_hash").alias("was")), after.select("path", F.col("content_hash").alias("is"))
    return b.join(a, "path", "full").where("not (was <=> is)").select("path")


def diff(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, delta, origin): findings (id, path) that are new or fixed; introduced if their path was touched, else derived."""
    new = after.join(before.select("id"), "id", "left_anti").select("id", "path", F.lit("new").alias("delta"))
    fixed = before.join(after.select("id"), "id", "left_anti").select("id", "path", F.lit("fixed").alias("delta"))
    mark = touched.select("path").distinct().withColumn("touched", F.lit(True))
    return new.union(fixed).join(mark, "path", "left").select("id", "delta", F.when(F.col("touched"), "introduced").otherwise("derived").alias("origin"))


def against_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, status): kept and acknowledged findings, and stale baseline ids that match none."""
    known = baseline.select("id").distinct()
    kept = findings.select("id").join(known, "id", "left_anti").withColumn("status", F.lit("kept"))
    acknowledged = findings.select("id").join(known, "id", "left_semi").withColumn("status", F.lit("acknowledged"))
    stale = known.join(findings.select("id"), "id", "left_anti").withColumn("status", F.lit("stale"))
    return kept.union(acknowledged).union(stale)


def bind_pragmas(pragmas: DataFrame, symbols: DataFrame) -> DataFrame:
    """(pragma, sym, first, last): each pragma with the first declaration that starts on its line or on the next one.

    pragmas: (pragma, path, line, last_line); symbols: (sym, path, first, last). Unbound pragmas have nulls.
    """
    starts = pragmas.select("pragma", "path", F.explode(F.array_distinct(F.array("line", F.col("last_line") + 1))).alias("at"))
    near = starts.join(symbols, (starts.path == symbols.path) & (starts["at"] == symbols["first"])).select("pragma", "sym", "first", "last")
    bound = near.groupBy("pragma").agg(F.min(F.struct("first", "sym", "last")).alias("b"))
    return pragmas.select("pragma").join(bound, "pragma", "left").select("pragma", F.col("b.sym").alias("sym"), F.col("b.first").alias("first"), F.col("b.last").alias("last"))


def suppress(findings: DataFrame, pragmas: DataFrame, bound: DataFrame) -> DataFrame:
    """(id, pragma): findings (id, path, line, category, subject) that a pragma covers.

    A pragma of scope file covers its whole file; another, the lines of the declaration it is bound to. Category must be
    equal, and the subject where the pragma names one.
    """
    placed = pragmas.join(bound, "pragma", "left").select("pragma", "path", "category", F.col("subject").alias("wanted"), "scope", "first", "last")
    met = findings.join(placed, ["path", "category"]).where("scope = 'file' or line between first and last").where("wanted is null or wanted = subject")
    return met.select("id", "pragma").distinct()


def stale_pragmas(pragmas: DataFrame, bound: DataFrame, suppressed: DataFrame, judged: list[str]) -> DataFrame:
    """(pragma, reason): unknown category, suppressing the meta category, unbound, or matching nothing that was judged."""
    rows = pragmas.join(bound.select("pragma", "sym"), "pragma", "left").join(suppressed.select("pragma").distinct().withColumn("used", F.lit(True)), "pragma", "left")
    reason = (
        F.when(~F.col("category").isin(*CATEGORIES), "unknown")
        .when(F.col("category") == META, "meta")
        .when((F.col("scope") != "file") & F.col("sym").isNull(), "unbound")
        .when(F.col("category").isin(*judged) & F.col("used").isNull(), "matched-nothing")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("pragma", "reason")


def nearest_category(names: DataFrame) -> DataFrame:
    """(name, hint): the known category within two edits of an unknown name, the nearest and then the least."""
    spark = names.sparkSession
    known = F.broadcast(spark.createDataFrame([(c,) for c in CATEGORIES], "hint string"))
    near = names.select("name").distinct().join(known, F.levenshtein("name", "hint") <= 2).groupBy("name").agg(F.min(F.struct(F.levenshtein("name", "hint").alias("d"), "hint")).alias("best"))
    return near.select("name", F.col("best.hint").alias("hint"))


def report_filter(findings: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, floor: int = 0) -> DataFrame:
    """Findings with their fate: elided (outside `only`), skipped (in `skip`; the meta category never), below, or shown."""
    fate = F.lit("shown")
    fate = F.when(F.col("confidence") < floor, "below").otherwise(fate)
    if skip:
        fate = F.when(F.col("category").isin(*skip) & (F.col("category") != META), "skipped").otherwise(fate)
    if only:
        fate = F.when(~F.col("category").isin(*only), "elided").otherwise(fate)
    return findings.withColumn("fate", fate)


def budgets(deltas: DataFrame, totals: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, measured, verdict): net budgets on new less fixed, absolute ones on the worst subject; over the limit fails.

    deltas: (category, delta, advisory); totals: (category, subject, advisory) of all findings; rules: (rule, category,
    kind net or per-subject, most). Advisory rows don't count. A rule that matches nothing measures 0.
    """
    net = deltas.where("not advisory").groupBy("category").agg(F.sum(F.when(F.col("delta") == "new", 1).otherwise(-1)).alias("net"))
    worst = totals.where("not advisory").groupBy("category", "subject").agg(F.count("*").alias("n")).groupBy("category").agg(F.max("n").alias("worst"))
    rows = rules.join(net, "category", "left").join(worst, "category", "left")
    measured = F.coalesce(F.when(F.col("kind") == "net", F.col("net")).otherwise(F.col("worst")), F.lit(0)).cast("bigint")
    return rows.select("rule", measured.alias("measured"), F.when(measured > F.col("most"), "fail").otherwise("pass").alias("verdict"))


def gate(findings: DataFrame, budget: DataFrame, threshold: int) -> DataFrame:
    """(worst, failed_budgets, verdict): fails on a finding of rank `threshold` that isn't advisory, or a failed budget."""
    worst = findings.where("not advisory").agg(F.coalesce(F.max("severity"), F.lit(-1)).alias("worst"))
    failed = budget.agg(F.count_if(F.col("verdict") == "fail").alias("failed_budgets"))
    return worst.crossJoin(failed).withColumn("verdict", F.when((F.col("worst") >= threshold) | (F.col("failed_budgets") > 0), "fail").otherwise("pass"))  # one row each


def provenance(findings: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, sources): who claimed the finding's file, and who contributed an edge that touches its node either way."""
    touching = edges.select(F.col("src").alias("node"), "source").union(edges.select(F.col("dst").alias("node"), "source")).distinct()
    of_node = findings.join(touching, "node").select("id", "source")
    of_file = findings.join(claims, "path").select("id", "source")
    sources = of_node.union(of_file).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return findings.select("id").join(sources, "id", "left").select("id", F.coalesce("sources", F.lit("")).alias("sources"))


def cap_per_rule(findings: DataFrame, most: int = 500) -> DataFrame:
    """Findings of plugins (rule, id): the first `most` of each rule by id; the feature is the cap."""
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("id"))
    return findings.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def display_order(findings: DataFrame) -> DataFrame:
    """Findings by severity (worst first), path, line, id."""
    return findings.orderBy(F.col("severity").desc(), "path", "line", "id")
