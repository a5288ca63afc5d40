"""The same scan over a stream of files: each arriving file is scanned once, on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus.operators import findings as A
from lynceus.operators import line_scanners as L
from lynceus.sources.config import Config
from lynceus.sources.files import guarded, lines_of, with_names

BINARY = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """Files as they arrive below folder; the folder that holds a file is its artifact."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    text, error = guarded(F.col("length"), F.col("content"))
    path = F.regexp_replace("path", r"\A[a-z]+:/+", "/")
    rows = raw.select(F.element_at(F.split(path, "/"), -2).alias("artifact_id"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("rel_path"), "length", text.alias("content"), error.alias("read_error"))
    return with_names(rows)


def findings_of(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings of the line scanners with severity and remediation."""
    return A.with_rules(L.scan_lines(lines_of(files), config or Config()))


def watch(files: DataFrame, target: str, checkpoint: str, config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Append findings of each micro-batch to Parquet at target, in a folder of the batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        findings_of(batch, config).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def severity_counts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("artifact_id").agg(*A.tallies()).drop("cost", "critical")
