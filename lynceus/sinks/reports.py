"""Reports as JSON, SARIF and text. JSON and SARIF are made by the plan, one row for each artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators.findings import ordered

TOOL, VERSION = "lynceus", "0.1.0"
FIELDS = ("rule_id", "message", "severity", "path", "line", "column", "scanner", "snippet", "suppressed", "suppression_reason", "remediation")


def finding_struct() -> Column:
    return F.struct(*(F.col(c).alias("file" if c == "path" else c) for c in FIELDS))


def in_order(found: DataFrame, value: Column, only: Column, to: str) -> Column:
    """The array of `value` of rows where `only`, in the order of their findings."""
    return F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("ordinal", value.alias("v"))))), lambda s: s["v"]).alias(to)


def json_reports(reports: DataFrame, found: DataFrame, mode: str = "skill") -> DataFrame:
    """artifact_id, json: the report of each artifact, with counts, active and suppressed findings."""
    rows = ordered(found, mode)
    lists = rows.groupBy("artifact_id").agg(in_order(rows, finding_struct(), ~F.col("suppressed"), "findings"), in_order(rows, finding_struct(), F.col("suppressed"), "hidden"))
    joined = reports.join(lists, "artifact_id", "left")
    summary = F.struct("errors", "warnings", "info", "suppressed").alias("summary")
    whole = F.struct(F.col("artifact_id").alias("skill"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scan_timestamp"), "status", "risk_level", "security_score", "security_grade", "passed", summary, F.coalesce("findings", F.array()).alias("findings"), F.coalesce("hidden", F.array()).alias("suppressed"))
    return joined.select("artifact_id", F.to_json(whole).alias("json"))


def sarif_rules(found: DataFrame, mode: str = "skill") -> DataFrame:
    """artifact_id, rule_id, rule_index (by id), message and remediation of each rule's first finding."""
    first = ordered(found, mode).groupBy("artifact_id", "rule_id").agg(F.min(F.struct("suppressed", "ordinal", "message", "remediation")).alias("f"))
    order = Window.partitionBy("artifact_id").orderBy("rule_id")
    return first.select("artifact_id", "rule_id", (F.row_number().over(order) - 1).cast("long").alias("rule_index"), F.col("f.message").alias("message"), F.col("f.remediation").alias("remediation"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").otherwise(severity)


def sarif_results(found: DataFrame, mode: str = "skill") -> DataFrame:
    """A row for each finding, active ones first: rule_id, rule_index, level, message, uri, start_line."""
    rules = sarif_rules(found, mode).select("artifact_id", "rule_id", "rule_index")
    rows = ordered(found, mode).join(rules, ["artifact_id", "rule_id"])
    return rows.select("artifact_id", "suppressed", "ordinal", "rule_id", "rule_index", sarif_level(F.col("severity")).alias("level"), "message", F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("uri"), F.col("line").alias("start_line"))


def sarif_runs(reports: DataFrame, found: DataFrame, mode: str = "skill") -> DataFrame:
    """artifact_id, run: a SARIF run of each artifact."""
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct(F.col("rule_id").alias("id"), text("message").alias("shortDescription"), F.when(F.col("remediation").isNotNull(), text("remediation")).alias("help"))
    rules = sarif_rules(found, mode).groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", rule.alias("r")))), lambda s: s["r"]).alias("rules"))
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", text("message").alias("message"), F.when(F.col("uri").isNotNull(), F.array(place)).alias("locations"))
    results = sarif_results(found, mode).groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("suppressed", "ordinal", result.alias("r")))), lambda s: s["r"]).alias("results"))
    joined = reports.join(rules, "artifact_id", "left").join(results, "artifact_id", "left")
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), F.coalesce("rules", F.array()).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.coalesce("results", F.array()).alias("results"), F.struct("security_score", "security_grade").alias("properties"))
    return joined.select("artifact_id", F.to_json(run).alias("run"))


def sarif(runs: DataFrame) -> DataFrame:
    """artifact_id, sarif: a document of each run."""
    return runs.select("artifact_id", F.concat(F.lit('{"version":"2.1.0","runs":['), "run", F.lit("]}")).alias("sarif"))


def merged_sarif(runs: DataFrame) -> str:
    """One document of all runs, put together on the driver for a file that one reader takes."""
    return '{"version":"2.1.0","runs":[' + ",".join(r.run for r in runs.orderBy("artifact_id").toLocalIterator()) + "]}"


def summed_counts(documents: DataFrame) -> DataFrame:
    """errors, warnings summed over JSON reports (column json)."""
    count = lambda k: F.coalesce(F.sum(F.coalesce(F.get_json_object("json", f"$.summary.{k}").cast("long"), F.lit(0))), F.lit(0)).alias(k)
    return documents.agg(count("errors"), count("warnings"))


def scanner_mark() -> Column:
    """PASS, WARN, FAIL, SKIP or OFF of a scanner's row with counts errors and warnings."""
    return F.when(F.col("skip_reason") == "disabled in config", "OFF").when(F.col("skipped"), "SKIP").when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS")


def text_report(report, scanners: list, found: list) -> str:
    """One artifact's report for a terminal: rows of reports, scanners and findings, ordered by ordinal."""
    out = [f"\n  Scan: {report.artifact_id}", "", "Scanners"]
    for s in scanners:
        mine = [f for f in found if f.scanner == s.scanner]
        mark = "OFF" if s.skip_reason == "disabled in config" else "SKIP" if s.skipped else "FAIL" if any(f.severity == "error" for f in mine) else "WARN" if any(f.severity == "warning" for f in mine) else "PASS"
        detail = s.skip_reason if s.skipped else f"{s.findings} findings, {s.files_scanned} files scanned" + (f"  Score: {s.scanner_score}/100 ({s.scanner_grade})" if s.scanner_score is not None else "")
        out.append(f"  [{mark:>4}] {s.scanner:<20} {detail}")
    rank = {"error": 0, "warning": 1, "info": 2}
    active = sorted((f for f in found if not f.suppressed), key=lambda f: rank[f.severity])
    hidden = [f for f in found if f.suppressed]
    for title, some in (("Findings", active), (f"Suppressed ({len(hidden)})", hidden)):
        if some:
            out += ["", title]
        for f in some:
            if f.suppressed:
                out.append(f"  [SKIP] {f.rule_id:<25} {f.suppression_reason or 'no reason given'}")
                continue
            out.append(f"  [{f.severity.upper():>7}] {f.rule_id:<25} {f.message}")
            if f.path:
                out.append(f"         {f.path}" + (f":{f.line}" if f.line is not None else ""))
            if f.snippet is not None:
                out.append(f"         > {f.snippet}")
    out += ["", f"Result: {report.status.upper()}  |  Score: {report.security_score}/100 ({report.security_grade})  |  {report.errors} errors, {report.warnings} warnings, {report.info} info, {report.suppressed} suppressed"]
    return "\n".join(out)


def collection_text(reports: list, totals, min_score: int | None = None) -> str:
    out = ["", "Collection"]
    for r in reports:
        out.append(f"  {r.artifact_id:<30} {r.status.upper():<8} {r.security_score:>3}/100 ({r.security_grade})" + (f" [< {min_score}]" if min_score is not None and r.security_score < min_score else ""))
    out.append(f"  {totals.artifacts} artifacts: {totals.passed} passed, {totals.warned} warned, {totals.failed} failed" + (f", {totals.below_min} below {min_score}" if min_score is not None else ""))
    return "\n".join(out)
