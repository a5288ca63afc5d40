"""Findings of external tools from their JSON, and the tools' runs over artifacts."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import time
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.sources.config import Config

SHELLCHECK = "array<struct<file:string,line:bigint,column:bigint,level:string,code:bigint,message:string,fix:struct<replacements:array<struct<replacement:string>>>>>"
SEMGREP = (
    "struct<results:array<struct<check_id:string,path:string,start:struct<line:bigint,col:bigint>,"
    "extra:struct<severity:string,message:string,lines:string,fix:string,metadata:struct<fix:string>>>>,stats:struct<total_files:bigint>>"
)
GITLEAKS = "array<struct<RuleID:string,Description:string,File:string,StartLine:bigint,StartColumn:bigint>>"
TIMEOUT_S, SEMGREP_TIMEOUT_S, BATCH = 60, 30, 50
TOOLS = ("shellcheck", "semgrep", "gitleaks")
COLUMNS = ("artifact_id", "path", "line", "column", "scanner", "rule_id", "pos", "message", "severity", "snippet", "remediation")


def parsed(outputs: DataFrame, schema: str) -> DataFrame:
    """outputs (artifact_id, stdout) with parsed, and error where the text isn't JSON. Blank output has neither."""
    blank = F.coalesce(F.trim("stdout"), F.lit("")) == ""
    read = outputs.withColumn("parsed", F.when(~blank, F.from_json("stdout", schema)))
    broken = ~blank & (F.col("parsed").isNull() | F.try_parse_json("stdout").isNull())
    return read.withColumn("error", F.when(broken, F.lit("output is not JSON")))


def shellcheck(outputs: DataFrame) -> DataFrame:
    item = F.col("i")
    rows = parsed(outputs, SHELLCHECK).select("artifact_id", F.posexplode("parsed").alias("pos", "i")).where(item["code"] > 0)
    level = F.coalesce(item["level"], F.lit("warning"))
    code = item["code"].cast("string")
    return rows.select(
        "artifact_id", item["file"].alias("path"), item["line"].alias("line"), item["column"].alias("column"), F.lit("shellcheck").alias("scanner"),
        F.concat(F.lit("shellcheck/SC"), code).alias("rule_id"), "pos", F.coalesce(item["message"], F.lit("shellcheck finding")).alias("message"),
        F.when(level.isin("error", "warning"), level).otherwise("info").alias("severity"),
        F.get(item["fix"]["replacements"], F.lit(0))["replacement"].alias("snippet"), F.concat(F.lit("See https://www.shellcheck.net/wiki/SC"), code).alias("remediation"),
    )


def semgrep(outputs: DataFrame) -> DataFrame:
    item = F.col("i")
    rows = parsed(outputs, SEMGREP).select("artifact_id", F.posexplode("parsed.results").alias("pos", "i"))
    severity = F.lower(F.coalesce(item["extra"]["severity"], F.lit("warning")))
    return rows.select(
        "artifact_id", item["path"].alias("path"), item["start"]["line"].alias("line"), item["start"]["col"].alias("column"), F.lit("semgrep").alias("scanner"),
        F.concat(F.lit("semgrep/"), F.coalesce(item["check_id"], F.lit("unknown"))).alias("rule_id"), "pos", F.coalesce(item["extra"]["message"], F.lit("semgrep finding")).alias("message"),
        F.when(severity.isin("error", "warning"), severity).otherwise("info").alias("severity"),
        F.regexp_replace(item["extra"]["lines"], r"(?U)\A\s+|\s+\z", "").alias("snippet"), F.coalesce(item["extra"]["metadata"]["fix"], item["extra"]["fix"]).alias("remediation"),
    )


def semgrep_files(outputs: DataFrame) -> DataFrame:
    """artifact_id, files_scanned: what the tool says, else the distinct files with results."""
    paths = F.size(F.array_distinct(F.array_compact(F.transform("parsed.results", lambda r: r["path"]))))
    return parsed(outputs, SEMGREP).select("artifact_id", F.when(F.col("parsed.results").isNull(), F.lit(0)).otherwise(F.coalesce("parsed.stats.total_files", paths)).cast("long").alias("files_scanned"))


def secrets(outputs: DataFrame) -> DataFrame:
    """Ingests a leak finder's report; every leak is an error."""
    item = F.col("i")
    rows = parsed(outputs, GITLEAKS).select("artifact_id", F.posexplode("parsed").alias("pos", "i"))
    return rows.select(
        "artifact_id", item["File"].alias("path"), item["StartLine"].alias("line"), item["StartColumn"].alias("column"), F.lit("secrets").alias("scanner"),
        F.concat(F.lit("secrets/"), item["RuleID"]).alias("rule_id"), "pos", F.coalesce(item["Description"], F.lit("secret")).alias("message"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("snippet"), F.lit("Revoke it and keep it out of files").alias("remediation"),
    )


def available(tool: str) -> bool:
    return shutil.which(tool) is not None


def run(command: Sequence[str], timeout_s: float = TIMEOUT_S, more: dict[str, str] | None = None) -> tuple[str | None, str | None, int]:
    """(stdout, reason for skipping, milliseconds) of a command, which is killed after timeout_s."""
    began = time.monotonic()
    try:
        out = subprocess.run(list(command), capture_output=True, timeout=timeout_s, check=False, env={**os.environ, **(more or {})}).stdout.decode("utf-8", "replace")
        reason = None
    except subprocess.TimeoutExpired:
        out, reason = None, f"{command[0]} timed out after {timeout_s:g} s"
    except OSError as e:
        out, reason = None, f"{command[0]} failed to start: {e}"
    return out, reason, round(1000 * (time.monotonic() - began))


@dataclass(frozen=True)
class Tool:
    """An external tool: its scanner, the files it reads (none named: all), and its command over a folder or some files."""

    scanner: str
    program: str
    extensions: tuple[str, ...]
    timeout_s: float
    command: Callable[[Config, str, list[str]], list[str]]  # of the configuration, the folder, and the files below it
    ingest: Callable[[DataFrame], DataFrame]
    by_folder: bool


def semgrep_rules(settings: dict) -> list[str]:
    """The --config arguments: what the configuration names, if it is a registry's name, an address or an existing path; else a local file of rules."""
    named = settings.get("config")
    if named:
        fine = named.startswith(("p/", "r/")) or named == "auto" or "://" in named or Path(named).exists()
        return ["--config", str(Path(named).resolve()) if Path(named).exists() else named] if fine else []
    return next((["--config", str(Path(f).resolve())] for f in ("semgrep.yml", ".semgrep.yml") if Path(f).exists()), [])


def semgrep_command(config: Config, folder: str, files: list[str]) -> list[str]:
    quiet = [] if config.semgrep.get("metrics") else ["--metrics=off"]
    return ["semgrep", "scan", "--json", "--quiet", *config.semgrep.get("arguments", ()), *quiet, folder]


def environment(config: Config) -> dict[str, str]:
    return {} if config.semgrep.get("version_check") else {"SEMGREP_ENABLE_VERSION_CHECK": "0"}


TOOL_KINDS = (
    Tool("shellcheck", "shellcheck", ("sh", "bash"), TIMEOUT_S, lambda config, folder, files: ["shellcheck", "-f", "json", "--severity=style", *files], shellcheck, False),
    Tool("secrets", "gitleaks", (), TIMEOUT_S, lambda config, folder, files: ["gitleaks", "dir", "--no-banner", "--report-format", "json", "--report-path", "-", folder], secrets, True),
    Tool("semgrep", "semgrep", (), SEMGREP_TIMEOUT_S, semgrep_command, semgrep, True),
)
OUTPUT = "artifact_id string, scanner string, stdout string, files_scanned long, skip_reason string, duration_ms long"


def prepared(config: Config) -> Config:
    """The configuration with the rules of semgrep looked up here, on the driver, whose folder they are named from."""
    return replace(config, semgrep={**config.semgrep, "arguments": tuple(semgrep_rules(config.semgrep))})


def run_tool(files: DataFrame, tool: Tool, config: Config | None = None) -> DataFrame:
    """A row for each run of a tool: artifact_id, scanner, stdout, files_scanned, skip_reason, duration_ms.

    Runs on the executors. Contents go to a scratch folder of the run, so files of any store can be scanned; paths in the
    output are those of the files. A tool that reads file by file gets `BATCH` files of an artifact at a time, one that
    reads a folder gets an artifact's files together.
    """
    config = prepared(config or Config())
    names = [n.split()[0] for n in OUTPUT.split(", ")]

    def over(artifact: str, rows: list[tuple[str, str, str]]) -> tuple:
        if not available(tool.program):
            return artifact, tool.scanner, None, 0, f"{tool.program} not found", 0
        with tempfile.TemporaryDirectory() as scratch:
            inner = []
            for path, rel, content in rows:
                at = Path(scratch, rel)
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(content, encoding="utf-8")
                inner.append(str(at))
            out, reason, took = run(tool.command(config, scratch, inner), tool.timeout_s, environment(config))
        base = rows[0][0].removesuffix(rows[0][1])
        return artifact, tool.scanner, out and out.replace(f"{scratch}/", base), 0 if reason else len(rows), reason, took

    def batches_of(batches):
        import pyarrow as pa

        for batch in batches:
            by_artifact = defaultdict(list)
            for row in zip(*(batch.column(c).to_pylist() for c in ("artifact_id", "path", "rel_path", "content")), strict=True):
                by_artifact[row[0]].append(row[1:])
            out = [over(a, rows[k : k + BATCH]) for a, rows in by_artifact.items() for k in range(0, len(rows), BATCH)]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=schema(pa))

    def folder_of(got):
        import pyarrow as pa

        rows = list(zip(*(got.column(c).to_pylist() for c in ("path", "rel_path", "content")), strict=True))
        out = over(got.column("artifact_id")[0].as_py(), sorted(rows))
        return pa.table({n: [out[k]] for k, n in enumerate(names)}, schema=schema(pa))

    def schema(pa):
        return pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in (c.split() for c in OUTPUT.split(", "))])

    read = files.where(F.col("content").isNotNull() & ~F.contains("rel_path", F.lit("../")))
    read = (read.where(F.col("ext").isin(*tool.extensions)) if tool.extensions else read).select("artifact_id", "path", "rel_path", "content")
    return read.groupBy("artifact_id").applyInArrow(folder_of, OUTPUT) if tool.by_folder else read.mapInArrow(batches_of, OUTPUT)


def runs(outputs: DataFrame) -> DataFrame:
    """artifact_id, scanner, files_scanned, skip_reason, error of the runs of a tool over an artifact."""
    bad = (F.coalesce(F.trim("stdout"), F.lit("")) != "") & F.try_parse_json("stdout").isNull()
    return outputs.groupBy("artifact_id", "scanner").agg(F.sum("files_scanned").alias("files_scanned"), F.max("skip_reason").alias("skip_reason"), F.max(F.when(bad, F.lit("output is not JSON"))).alias("error"))
