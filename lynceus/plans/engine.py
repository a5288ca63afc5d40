"""A whole audit as one lazy plan over all artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.operators import findings as A
from lynceus.operators import line_scanners as L
from lynceus.operators.extension import Scanner
from lynceus.operators.external import COLUMNS
from lynceus.operators.metadata import SCANNER, scan_metadata
from lynceus.rules import catalogue as R
from lynceus.sources.config import Config
from lynceus.sources.files import SENTINELS, SUPPRESSION, lines_of

READ_ERRORS = ("bash_patterns", "prompt", "typescript_patterns")


@dataclass(frozen=True)
class Audit:
    findings: DataFrame
    scanners: DataFrame
    reports: DataFrame


def read_errors(files: DataFrame, config: Config) -> DataFrame:
    """Findings of the three scanners that report files which can't be read."""
    bad = files.where(F.col("read_error").isNotNull())
    names = {r.scanner: r for r in R.READ_ERRORS}
    out = []
    for s in READ_ERRORS:
        benign = F.lower("stem").isin(*R.BENIGN_STEMS) if s == "prompt" else F.lit(False)
        if config.enabled(s):
            out.append(F.when(L.reads(s) & ~benign, F.struct(F.lit(s).alias("scanner"), F.lit(names[s].id).alias("rule_id"))))
    each = F.explode(F.array_compact(F.array(*out))) if out else F.explode(F.array().cast("array<struct<scanner:string,rule_id:string>>"))
    return bad.withColumn("h", each).select("artifact_id", "path", F.lit(None).cast("long").alias("line"), "h.scanner", "h.rule_id", F.lit(0).alias("pos"), F.concat(F.lit("A file can't be read: "), "read_error").alias("message"), F.lit(None).cast("string").alias("snippet"))


def scanner_results(files: DataFrame, artifacts: DataFrame, mode: str, config: Config) -> DataFrame:
    """A row for each artifact and scanner: files_scanned, skipped, skip_reason, error.

    Files count once for every scanner that reads them, unreadable and benign ones as well.
    """
    counts = [F.count_if(L.reads(s)).alias(s) for s in L.EXTENSIONS]
    root = F.col("rel_path") == SENTINELS[mode]
    own = SCANNER[mode]
    per = files.groupBy("artifact_id").agg(*counts, F.count_if(root).alias(own), F.max(F.when(root, F.col("read_error"))).alias("_error"))
    rows = artifacts.join(per, "artifact_id", "left")
    made = []
    for s in R.ORDER[mode]:
        external = s in ("shellcheck", "secrets", "semgrep")
        on = config.enabled(s)
        reason = F.lit("disabled in config") if not on else F.lit(f"{s} was not run") if external else F.lit(None).cast("string")
        n = F.coalesce(F.col(s), F.lit(0)).cast("long") if on and not external else F.lit(0).cast("long")
        error = F.concat(F.lit(f"Failed to read {SENTINELS[mode]}: "), F.col("_error")) if s == own and on else F.lit(None).cast("string")
        made.append(F.struct(F.lit(s).alias("scanner"), n.alias("files_scanned"), F.lit(external or not on).alias("skipped"), reason.alias("skip_reason"), error.alias("error")))
    return rows.select("artifact_id", F.explode(F.array(*made)).alias("r")).select("artifact_id", "r.*")


def with_runs(results: DataFrame, ran: DataFrame) -> DataFrame:
    """Results of scanners with what runs of tools (artifact_id, scanner, files_scanned, skip_reason, error) say of theirs."""
    fields = ("files_scanned", "skip_reason", "error")
    known = ran.select("artifact_id", "scanner", F.struct(*fields).alias("run"))
    both = results.join(known, ["artifact_id", "scanner"], "left")
    off = F.col("run").isNull() | (F.col("skip_reason") == "disabled in config")
    now = {f: F.when(off, F.col(f)).otherwise(F.col(f"run.{f}")) for f in fields}
    return both.withColumns({"skipped": F.when(off, F.col("skipped")).otherwise(F.col("run.skip_reason").isNotNull())} | now).drop("run")


def results_of(scanners: Sequence[Scanner], files: DataFrame, artifacts: DataFrame, config: Config) -> DataFrame:
    """The rows of scanner_results for scanners that are not built in."""
    counts = files.groupBy("artifact_id").agg(*(F.count_if(s.reads()).alias(s.name) for s in scanners))
    made = []
    for s in scanners:
        reason = None if config.enabled(s.name) and s.available() else "disabled in config" if not config.enabled(s.name) else f"{s.name} not found"
        n = F.lit(0) if reason else F.coalesce(s.name, F.lit(0))
        made.append(F.struct(F.lit(s.name).alias("scanner"), n.cast("long").alias("files_scanned"), F.lit(reason is not None).alias("skipped"), F.lit(reason).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("error")))
    return artifacts.join(counts, "artifact_id", "left").select("artifact_id", F.explode(F.array(*made)).alias("r")).select("artifact_id", "r.*")


def audit(
    files: DataFrame,
    artifacts: DataFrame,
    mode: str = "skill",
    config: Config | None = None,
    suppressions: DataFrame | None = None,
    tools: DataFrame | None = None,
    runs: DataFrame | None = None,
    scanners: Sequence[Scanner] = (),
) -> Audit:
    """Scan files of artifacts (artifact_id, name). tools and runs: findings and runs of external tools, as operators.external makes them."""
    config = config or Config()
    spark: SparkSession = files.sparkSession
    lines = lines_of(files)
    found = L.scan_lines(lines, config).unionByName(read_errors(files, config))
    if config.enabled(SCANNER[mode]):
        found = found.unionByName(scan_metadata(files, lines, artifacts, mode))
    active = [s for s in scanners if config.enabled(s.name) and s.available()]
    for s in active:
        found = found.unionByName(s.scan(files, lines, config))
    found = A.with_rules(found, tuple(r for s in active for r in s.rules)).withColumn("column", F.lit(None).cast("long"))
    if tools is not None:
        known = tools.select(*COLUMNS).withColumn("rule_ord", F.lit(0))
        off = [s for s in ("shellcheck", "semgrep", "secrets") if not config.enabled(s)]
        found = found.unionByName(known.where(~F.col("scanner").isin(*off)) if off else known)
    entries = suppressions if suppressions is not None else spark.createDataFrame([], SUPPRESSION)
    found = A.suppress(found, entries)
    results = scanner_results(files, artifacts, mode, config)
    if scanners:
        results = results.unionByName(results_of(scanners, files, artifacts, config))
    if runs is not None:
        results = with_runs(results, runs)
    elif tools is not None:
        ran = tools.select("artifact_id", "scanner").distinct().withColumn("ran", F.lit(True))
        results = results.join(ran, ["artifact_id", "scanner"], "left").withColumns({"skip_reason": F.when(F.col("ran").isNull(), F.col("skip_reason")), "skipped": F.col("skipped") & F.col("ran").isNull()}).drop("ran")
    scanned = results.groupBy("artifact_id").agg(F.sum("files_scanned").alias("files_scanned"))
    reports = A.artifact_reports(artifacts, found, config.strict).join(scanned, "artifact_id", "left")
    return Audit(found, A.scanner_reports(results, found), reports)
