"""Configuration and suppressions from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from lynceus.rules import catalogue as R

CONFIG_NAME = "audit.toml"
#: At the root of an artifact; also with a dot in front.
IGNORE_NAME = "audit-ignore"


@dataclass(frozen=True)
class Config:
    """Every field has a default; allowlists are in lower case."""

    domains: tuple[str, ...] = R.DOMAINS
    registries: tuple[str, ...] = R.REGISTRIES
    strict: bool = False
    scanners: dict[str, bool] = field(default_factory=dict)
    semgrep: dict = field(default_factory=dict)
    #: Names that inline marks may have besides the fixed ones.
    marks: tuple[str, ...] = ()

    def enabled(self, scanner: str) -> bool:
        """Scanners that the configuration doesn't name are on; short names do as well as full ones."""
        short = {"bash_patterns": "bash", "typescript_patterns": "typescript"}.get(scanner, scanner)
        return self.scanners.get(scanner, self.scanners.get(short, True))


def load(path: str | None = None) -> Config:
    """The file at path, which must exist; without a path, CONFIG_NAME if it is there, else defaults."""
    if path is None and not Path(CONFIG_NAME).is_file():
        return Config()
    with open(path or CONFIG_NAME, "rb") as f:
        return parse(tomllib.load(f))


def parse(raw: dict) -> Config:
    allow = raw.get("allowlist", {})
    strict = raw.get("strict", False)
    lower = lambda values: tuple(str(v).lower() for v in values)
    return Config(
        domains=lower(allow.get("domains", R.DOMAINS)),
        registries=lower(allow.get("registries", R.REGISTRIES)),
        strict=bool(strict.get("enabled", False) if isinstance(strict, dict) else strict),
        scanners={str(k): bool(v) for k, v in raw.get("scanners", {}).items()},
        semgrep=dict(raw.get("semgrep", {})),
        marks=lower(raw.get("inline", {}).get("marks", ())),
    )


def suppressions(text: str) -> list[dict]:
    """The [[suppress]] entries of an ignore file in their order; none if it isn't valid.

    Entries whose file is absolute or climbs with .. are dropped.
    """
    try:
        entries = tomllib.loads(text).get("suppress", [])
        rows = [{"ordinal": i, "rule": e["rule"], "file": e["file"], "lines": e.get("lines"), "reason": e["reason"], "ticket": e.get("ticket")} for i, e in enumerate(entries)]
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
        return []
    return [r for r in rows if not r["file"].startswith("/") and ".." not in PurePosixPath(r["file"]).parts]
