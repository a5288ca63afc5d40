"""Command line: scan, scan-all, check-tools, list-rules, explain. Exit codes: 0 passed, 1 not, 2 wrong use."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lynceus.rules import catalogue as R
from lynceus.sources.files import SENTINELS


def rules_of(mode: str) -> tuple[R.Rule, ...]:
    return {"skill": (*R.COMMON, *R.FRONTMATTER), "agent": (*R.COMMON, *R.AGENT)}.get(mode, R.ALL) + R.READ_ERRORS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lynceus")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("scan", "scan-all"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--type", choices=("skill", "agent"), default="skill")
        c.add_argument("--format", choices=("pretty", "json", "sarif"), default="pretty")
        c.add_argument("--strict", action="store_true")
        c.add_argument("--config")
        c.add_argument("--min-score", type=int)
        if name == "scan":
            c.add_argument("--output")
    commands.add_parser("check-tools")
    for name in ("list-rules", "explain"):
        c = commands.add_parser(name)
        if name == "explain":
            c.add_argument("rule")
        c.add_argument("--mode", choices=("skill", "agent", "all"), default="all")
    return out


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "check-tools":
        from lynceus.operators.external import TOOL_KINDS, available

        programs = {t.scanner: t.program for t in TOOL_KINDS}
        for s in dict.fromkeys((*R.ORDER["skill"], *R.ORDER["agent"])):
            ready = s not in programs or available(programs[s])
            print(f"{s:<20} {'available' if ready else f'{programs[s]} not found'}")
        return 0
    if args.command == "list-rules":
        rules = rules_of(args.mode)
        for scanner in dict.fromkeys(r.scanner for r in rules):
            print(scanner)
            for r in rules:
                if r.scanner == scanner:
                    print(f"  [{r.severity:<7}] {r.id:<40} {r.message}")
        return 0
    if args.command == "explain":
        found = next((r for r in rules_of(args.mode) if r.id == args.rule), None)
        if found is None:
            print(f"no rule {args.rule}", file=sys.stderr)
            return 2
        print(f"{found.id}\n  severity: {found.severity}\n  scanner: {found.scanner}\n  {found.message}\n  {found.remediation}")
        return 0
    return scan(args)


def scan(args: argparse.Namespace) -> int:
    from functools import reduce
    from itertools import groupby

    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql import functions as F

    from lynceus.operators.external import TOOL_KINDS, available, run_tool, runs
    from lynceus.operators.findings import collection_totals, ordered
    from lynceus.plans.engine import audit
    from lynceus.sinks import reports as S
    from lynceus.sources import config as C
    from lynceus.sources.files import from_folder, suppressions_of

    root, whole = Path(args.path), args.command == "scan-all"
    sentinel = SENTINELS[args.type]
    if not root.is_dir():
        print(f"no folder {root}", file=sys.stderr)
        return 2
    inner = sorted(p.name for p in root.iterdir() if (p / sentinel).is_file()) if not (root / sentinel).exists() else []
    if whole and not inner:
        print(f"no {sentinel} in a folder of {root}", file=sys.stderr)
        return 2
    if not whole and inner:
        print(f"{root} is a collection; use scan-all", file=sys.stderr)
        return 2
    try:
        config = C.load(args.config)
    except (OSError, ValueError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    config = C.Config(**{**config.__dict__, "strict": config.strict or args.strict})
    spark = SparkSession.builder.appName("lynceus").getOrCreate()
    names = inner if whole else [root.resolve().name]
    artifacts = spark.createDataFrame([(n, n) for n in names], "artifact_id string, name string")
    files = from_folder(spark, str(root.resolve()), whole)
    files = files.join(artifacts.select("artifact_id"), "artifact_id", "left_semi")
    tools = [t for t in TOOL_KINDS if config.enabled(t.scanner) and available(t.program)]
    outputs = [(t, run_tool(files, t, config).persist()) for t in tools]  # a tool runs once, whatever reads its output
    found = reduce(DataFrame.unionByName, (t.ingest(o) for t, o in outputs)) if outputs else None
    ran = reduce(DataFrame.unionByName, (runs(o) for _, o in outputs)) if outputs else None
    done = audit(files, artifacts, args.type, config, suppressions_of(files), found, ran)
    found = ordered(done.findings, args.type)
    if args.format == "sarif":
        text = S.merged_sarif(S.sarif_runs(done.reports, done.findings, args.type))
    elif args.format == "json":
        text = "\n".join(r.json for r in S.json_reports(done.reports, done.findings, args.type).orderBy("artifact_id").collect())
    else:
        by_artifact = lambda rows: {k: list(v) for k, v in groupby(rows, key=lambda r: r.artifact_id)}
        rows = by_artifact(found.orderBy("artifact_id", "ordinal").collect())
        scanners = by_artifact(done.scanners.orderBy("artifact_id").collect())
        parts = [S.text_report(r, scanners.get(r.artifact_id, []), rows.get(r.artifact_id, [])) for r in done.reports.orderBy("artifact_id").collect()]
        if whole:
            parts.append(S.collection_text(done.reports.orderBy("artifact_id").collect(), collection_totals(done.reports, args.min_score).first(), args.min_score))
        text = "\n".join(parts)
    if getattr(args, "output", None):
        Path(args.output).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)
    gate = collection_totals(done.reports.withColumn("artifact_id", F.col("artifact_id")), args.min_score).first().gate
    return 0 if gate else 1


if __name__ == "__main__":
    sys.exit(main())
