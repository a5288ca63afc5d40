"""Where further scanners join an audit."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators import line_scanners as L
from lynceus.rules import catalogue as R
from lynceus.sources.config import Config


@runtime_checkable
class Scanner(Protocol):
    """What an audit asks of a scanner. Its rows are findings: artifact_id, path, line, scanner, rule_id, pos, message, snippet."""

    name: str
    description: str
    rules: tuple[R.Rule, ...]

    def available(self) -> bool: ...

    def reads(self) -> Column:
        """Whether the scanner reads a file, by the columns of a table of files."""

    def scan(self, files: DataFrame, lines: DataFrame, config: Config) -> DataFrame: ...


@dataclass(frozen=True)
class PatternScanner:
    """A scanner of one's own patterns over the lines of files with some extensions, as the built-in ones do it."""

    name: str
    description: str
    rules: tuple[R.Rule, ...]
    extensions: tuple[str, ...]

    def available(self) -> bool:
        return True

    def reads(self) -> Column:
        return F.col("ext").isin(*self.extensions)

    def scan(self, files: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
        from lynceus.functions import text as X

        line = F.col("line")
        hits = F.when(~L.ignored(line, config), L.when_hits(*((X.matches(line, r.pattern), r) for r in self.rules))).otherwise(L.none())
        found = lines.where(self.reads()).withColumn("h", F.explode(hits))
        return found.select("artifact_id", "path", F.col("line_no").alias("line"), "h.scanner", "h.rule_id", "h.pos", "h.message", X.snippet_cut_first(line).alias("snippet"))
