"""From findings to reports: suppression, counts, scores, grades, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynceus.rules import catalogue as R

CRITICAL = r"^(bash|typescript)/CAT-[AD]|^prompt/"
#: What a finding takes off 100, and the least score of each grade: fixed values.
COST = {"critical": 30, "error": 15, "warning": 5, "info": 1}
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))
SEVERITIES = ("error", "warning", "info")


def catalogue(spark: SparkSession, rules: tuple[R.Rule, ...] = (*R.ALL, *R.READ_ERRORS)) -> DataFrame:
    return spark.createDataFrame([(i, r.id, r.severity, r.scanner, r.message, r.remediation) for i, r in enumerate(rules)], "rule_ord int, rule_id string, severity string, scanner string, rule_message string, remediation string")


def with_rules(found: DataFrame, more: tuple[R.Rule, ...] = ()) -> DataFrame:
    """Severity, remediation and order of each finding's rule, of the catalogue or of `more`. Rules are code, not data, so they are broadcast."""
    rules = catalogue(found.sparkSession, (*R.ALL, *R.READ_ERRORS, *more)).select("rule_id", "rule_ord", "severity", "remediation")
    return found.join(F.broadcast(rules), "rule_id")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def line_range(lines: Column) -> tuple[Column, Column, Column]:
    """(begin, end, valid) of "n" or "a-b"; anything else, or a > b, is not valid."""
    one = lines.rlike(r"\A\+?[0-9]+\z")
    two = lines.rlike(r"\A\+?[0-9]+-\+?[0-9]+\z")
    begin = F.when(one | two, F.split_part(lines, F.lit("-"), F.lit(1)).try_cast("long"))
    end = F.when(one, begin).when(two, F.split_part(lines, F.lit("-"), F.lit(2)).try_cast("long"))
    return begin, end, F.coalesce(begin <= end, F.lit(False))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(\A|/)(\./)+", "$1"), "/\\z", "")


def ends_with_path(path: Column, tail: Column) -> Column:
    """Whether whole components of path end it as tail does."""
    p, t = normal_path(path), normal_path(tail)
    return (t == "") | (p == t) | p.endswith(F.concat(F.lit("/"), t))


def suppress(found: DataFrame, entries: DataFrame) -> DataFrame:
    """found with suppressed and suppression_reason: of all entries that fit a finding the first counts.

    Entries are written by hand, so those of one artifact and rule are few: they meet a finding as one array, and findings
    go through a single join, which the planner broadcasts only where the entries are small.
    """
    begin, end, valid = line_range(F.col("lines"))
    entry = F.struct("ordinal", "reason", "file", F.col("lines").isNotNull().alias("ranged"), begin.alias("begin"), end.alias("end"), valid.alias("valid"))
    rules = entries.groupBy(F.col("artifact_id").alias("s_artifact"), F.col("rule").alias("s_rule")).agg(F.sort_array(F.collect_list(entry)).alias("s_entries"))
    fits_file = lambda e: F.when(F.col("path").isNull(), e["file"] == "").otherwise(ends_with_path(F.col("path"), e["file"]))
    fits_line = lambda e: ~e["ranged"] | F.col("line").isNull() | (e["valid"] & F.col("line").between(e["begin"], e["end"]))
    joined = found.join(rules, (F.col("artifact_id") == F.col("s_artifact")) & (F.col("rule_id") == F.col("s_rule")), "left")
    first = F.get(F.filter("s_entries", lambda e: fits_file(e) & fits_line(e)), F.lit(0))
    out = joined.withColumn("s_first", F.when(F.col("s_entries").isNotNull(), first))
    return out.withColumns({"suppression_reason": F.col("s_first.reason"), "suppressed": F.col("s_first").isNotNull()}).drop("s_artifact", "s_rule", "s_entries", "s_first")


def is_critical(rule_id: Column) -> Column:
    return rule_id.rlike(CRITICAL)


def cost(severity: Column, rule_id: Column) -> Column:
    return F.when(severity == "error", F.when(is_critical(rule_id), COST["critical"]).otherwise(COST["error"])).when(severity == "warning", COST["warning"]).otherwise(COST["info"])


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def tallies(among: Column | None = None) -> list[Column]:
    """Counts and costs of findings, of those `among` alone if it is given."""
    among = F.lit(True) if among is None else among
    counts = [F.count_if(among & (F.col("severity") == s)).alias(n) for s, n in zip(SEVERITIES, ("errors", "warnings", "info"), strict=True)]
    total = F.coalesce(F.sum(F.when(among, cost(F.col("severity"), F.col("rule_id")))), F.lit(0)).cast("long").alias("cost")
    return [*counts, total, F.count_if(among & (F.col("severity") == "error") & is_critical(F.col("rule_id"))).alias("critical")]


def judged(counts: DataFrame, strict: bool) -> DataFrame:
    """Score, grade, status, risk and whether it passes, from tallies (null: no finding)."""
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("errors", "warnings", "info", "cost", "critical")}
    score = F.greatest(F.lit(0), 100 - F.col("cost")).cast("int")
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "failed" if strict else "warning").otherwise("passed")
    risk = F.when(F.col("critical") > 0, "critical").when(F.col("errors") > 0, "high").when(F.col("warnings") > 0, "medium").otherwise("low")
    out = counts.withColumns(zero).withColumn("security_score", score)
    return out.withColumns({"security_grade": grade(F.col("security_score")), "status": status, "risk_level": risk, "passed": status == "passed"}).drop("cost", "critical")


def artifact_reports(artifacts: DataFrame, found: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each artifact, those without findings too; suppressed findings only count as such."""
    counts = found.groupBy("artifact_id").agg(*tallies(~F.col("suppressed")), F.count_if("suppressed").alias("suppressed"))
    joined = artifacts.join(counts, "artifact_id", "left")
    return judged(joined.withColumn("suppressed", F.coalesce("suppressed", F.lit(0)).cast("long")), strict)


def scanner_reports(results: DataFrame, found: DataFrame) -> DataFrame:
    """Score and grade of each scanner over all its findings, suppressed or not; none where it was skipped or failed."""
    counts = found.groupBy("artifact_id", "scanner").agg(F.count("*").alias("findings"), *tallies())
    rows = results.join(counts, ["artifact_id", "scanner"], "left")
    ran = ~F.col("skipped") & F.col("error").isNull()
    score = F.when(ran, F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("int"))
    rows = rows.withColumns({"findings": F.coalesce("findings", F.lit(0)).cast("long"), "scanner_score": score})
    return rows.withColumn("scanner_grade", F.when(F.col("scanner_score").isNotNull(), grade(F.col("scanner_score")))).drop("errors", "warnings", "info", "cost", "critical")


def ordered(found: DataFrame, mode: str = "skill") -> DataFrame:
    """ordinal (0, 1, ... in each artifact): by scanner, file, line, rule and place in the line. A sort for sinks only."""
    place = F.array_position(F.array(*map(F.lit, R.ORDER[mode])), F.col("scanner"))
    order = Window.partitionBy("artifact_id").orderBy(place, "path", F.col("line").asc_nulls_first(), "rule_ord", "pos")
    return found.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))


def collection_totals(reports: DataFrame, min_score: int | None = None) -> DataFrame:
    """One row: artifacts that failed, warned, passed, lie below the least score; and whether the gate opens."""
    below = F.col("security_score") < min_score if min_score is not None else F.lit(False)
    return reports.agg(
        F.count("*").alias("artifacts"),
        *(F.count_if(F.col("status") == s).alias(n) for s, n in (("failed", "failed"), ("warning", "warned"), ("passed", "passed"))),
        F.count_if(below).alias("below_min"),
        F.coalesce(F.every(F.col("passed") & ~below), F.lit(True)).alias("gate"),
    )


def rule_totals(found: DataFrame) -> DataFrame:
    """Findings by scanner and rule with subtotals (null) for scanners and for all."""
    return found.rollup("scanner", "rule_id").agg(F.count("*").alias("n"))

