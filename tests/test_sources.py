"""Files of folders, tools over them, and scanners that join from outside."""

import os

import pytest
from pyspark.sql import functions as F

from lynceus import cli
from lynceus.operators import external
from lynceus.operators.extension import PatternScanner, Scanner
from lynceus.plans.engine import audit
from lynceus.rules.catalogue import Rule
from lynceus.sources import files as Fs
from lynceus.sources.config import Config


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for name, text in {"s/SKILL.md": "---\nname: s\ndescription: Use when x\n---\n", "s/.x/a.sh": "eval $x\n", "s/_x/b.sh": "eval $x\n", "s/.e.sh": "eval $x\n", "s/_d.sh": "eval $x\n", "s/c.sh": "eval $x\n", "s/k=v/_y=1/f.sh": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "s/big.sh").write_bytes(b"x" * (11 * 1024 * 1024))
    (root / "s/bad.sh").write_bytes(b"\xff")
    (tmp_path / "outside.sh").write_text("eval $x\n")
    os.symlink(tmp_path / "outside.sh", root / "s/link.sh")
    os.symlink(root, root / "s/loop")
    return root


def test_hidden_files_are_read_and_links_are_not(spark, folder):
    rows = {r.rel_path: r for r in Fs.from_folder(spark, str(folder), True).collect()}
    assert set(rows) == {"SKILL.md", ".x/a.sh", "_x/b.sh", ".e.sh", "_d.sh", "c.sh", "k=v/_y=1/f.sh", "big.sh", "bad.sh"}
    assert rows["big.sh"].content is None and rows["big.sh"].length == 11 * 1024 * 1024 and rows["big.sh"].read_error.startswith("file of 11534336 bytes")
    assert rows["bad.sh"].read_error == "not UTF-8" and rows[".x/a.sh"].content == "eval $x\n" and rows[".x/a.sh"].artifact_id == "s"
    artifacts = spark.createDataFrame([("s", "s")], "artifact_id string, name string")
    found = audit(Fs.from_folder(spark, str(folder), True), artifacts).findings.collect()
    assert sorted(r.path.split("/s/")[1] for r in found if r.rule_id == "bash/CAT-A2") == [".e.sh", ".x/a.sh", "_d.sh", "_x/b.sh", "c.sh"]
    assert sorted(r.path.split("/s/")[1] for r in found if r.rule_id == "bash/read-error") == ["bad.sh", "big.sh"]


def test_other_stores_give_the_same(spark, folder, monkeypatch):
    want = {(r.artifact_id, r.rel_path, r.length, r.content, r.read_error) for r in Fs.from_folder(spark, str(folder), True).collect()}
    (folder / "s/link.sh").unlink()
    (folder / "s/loop").unlink()
    monkeypatch.setattr(Fs, "is_local", lambda root: False)  # by listing and scans, as for a remote store
    got = {(r.artifact_id, r.rel_path, r.length, r.content, r.read_error) for r in Fs.from_folder(spark, f"file://{folder}", True).collect()}
    assert got == want


def test_a_single_artifact_and_an_empty_folder(spark, folder, tmp_path):
    rows = Fs.from_folder(spark, str(folder / "s")).collect()
    assert {r.artifact_id for r in rows} == {"s"} and ".x/a.sh" in {r.rel_path for r in rows}
    (tmp_path / "none").mkdir()
    assert Fs.from_folder(spark, str(tmp_path / "none")).count() == 0


def program(folder, name, text):
    path = folder / name
    path.write_text(f"#!/bin/sh\n{text}\n")
    path.chmod(0o755)


def test_tools_run_where_the_files_are(spark, folder, tmp_path, monkeypatch, capsys):
    tools = tmp_path / "bin"
    tools.mkdir()
    program(tools, "shellcheck", """shift 3; printf '['; sep=''; for f in "$@"; do printf '%s{"file":"%s","line":1,"column":1,"level":"warning","code":2046,"message":"m"}' "$sep" "$f"; sep=','; done; printf ']'""")
    program(tools, "gitleaks", "exec sleep 30")
    program(tools, "semgrep", "echo not json")
    monkeypatch.setenv("PATH", f"{tools}:{os.environ['PATH']}")
    files = Fs.from_folder(spark, str(folder), True)
    check, leaks, grep = external.TOOL_KINDS
    # workers may have an older PATH, so the programs are named in full
    named = lambda t, **more: external.replace(t, program=str(tools / t.program), command=lambda c, d, f, g=t.command: [str(tools / g(c, d, f)[0]), *g(c, d, f)[1:]], **more)
    out = external.run_tool(files, named(check)).collect()
    assert sum(r.files_scanned for r in out) == 6 and all(r.skip_reason is None for r in out)
    found = external.shellcheck(spark.createDataFrame(out, external.OUTPUT)).collect()
    assert {r.path for r in found} == {str(folder / "s" / n) for n in (".x/a.sh", "_x/b.sh", ".e.sh", "_d.sh", "c.sh", "k=v/_y=1/f.sh")}
    late = external.run_tool(files, named(leaks, timeout_s=0.3)).collect()
    assert len(late) == 1 and "timed out" in late[0].skip_reason and late[0].files_scanned == 0
    broken = external.runs(external.run_tool(files, named(grep))).collect()
    assert [(r.scanner, r.error, r.skip_reason) for r in broken] == [("semgrep", "output is not JSON", None)]
    missing = external.run_tool(files, external.replace(check, program="no-such-tool")).collect()
    assert {r.skip_reason for r in missing} == {"no-such-tool not found"}

    artifacts = spark.createDataFrame([("s", "s")], "artifact_id string, name string")
    outputs = spark.createDataFrame(out + late, external.OUTPUT)
    done = audit(files, artifacts, tools=external.shellcheck(outputs.where("scanner = 'shellcheck'")), runs=external.runs(outputs))
    results = {r.scanner: r for r in done.scanners.collect()}
    assert (results["shellcheck"].skipped, results["shellcheck"].files_scanned, results["shellcheck"].findings, results["shellcheck"].scanner_score) == (False, 6, 6, 70)
    assert results["secrets"].skipped and "timed out" in results["secrets"].skip_reason and results["semgrep"].skip_reason == "semgrep was not run"
    assert cli.main(["check-tools"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 13 and any(s.split() == ["shellcheck", "available"] for s in said) and any(s.startswith("agent_frontmatter") for s in said)


def test_rules_of_semgrep(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert external.semgrep_rules({}) == [] and external.semgrep_rules({"config": "--evil"}) == []
    assert external.semgrep_rules({"config": "p/ci"}) == ["--config", "p/ci"] and external.semgrep_rules({"config": "https://x.dev/r"}) == ["--config", "https://x.dev/r"]
    (tmp_path / ".semgrep.yml").write_text("")
    assert external.semgrep_rules({}) == ["--config", str(tmp_path / ".semgrep.yml")]
    (tmp_path / "semgrep.yml").write_text("")
    assert external.semgrep_rules({}) == ["--config", str(tmp_path / "semgrep.yml")] == external.semgrep_rules({"config": "semgrep.yml"})
    plain = external.semgrep_command(external.prepared(Config()), "/d", [])
    assert plain[:4] == ["semgrep", "scan", "--json", "--quiet"] and plain[-1] == "/d" and "--metrics=off" in plain
    assert external.environment(Config()) == {"SEMGREP_ENABLE_VERSION_CHECK": "0"} and external.environment(Config(semgrep={"version_check": True})) == {}
    assert "--metrics=off" not in external.semgrep_command(external.prepared(Config(semgrep={"metrics": True})), "/d", [])


def test_a_scanner_from_outside(spark, folder):
    todo = Rule("todo/T1", "warning", "todo", "An open task", "Do it", r"(?i)\beval\b")
    mine = PatternScanner("todo", "Open tasks", (todo,), ("sh",))
    assert isinstance(mine, Scanner)
    files = Fs.from_folder(spark, str(folder), True)
    artifacts = spark.createDataFrame([("s", "s")], "artifact_id string, name string")
    done = audit(files, artifacts, scanners=[mine])
    assert done.findings.where("rule_id = 'todo/T1' AND severity = 'warning' AND remediation = 'Do it'").count() == 5
    row = done.scanners.where("scanner = 'todo'").first()
    assert (row.files_scanned, row.findings, row.skipped, row.scanner_score) == (8, 5, False, 75)
    off = audit(files, artifacts, config=Config(scanners={"todo": False}), scanners=[mine])
    assert off.findings.where("scanner = 'todo'").count() == 0 and off.scanners.where("scanner = 'todo'").first().skip_reason == "disabled in config"
    assert done.reports.select(F.sum("warnings")).first()[0] == off.reports.select(F.sum("warnings")).first()[0] + 5
