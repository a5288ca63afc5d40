"""Column expressions and table helpers that the operators share."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def worded_lines(text: Column) -> Column:
    r"""The \n-split lines that hold at least one word."""
    return F.filter(F.split(text_or_empty(text), "\n"), lambda line: line.rlike(NOT_GAP))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names; on one machine, where none is named, one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While false, small results are written by few tasks; while true, by one for each core.
PARALLEL_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: Settings belong to the session, so only one `cut` at a time has them changed.
_settings = threading.Lock()
#: Seconds between two collections of the driver's garbage.
SWEEP_S = 2.0
_swept = [0.0]


def cut(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no lost executor takes it along.

    arrow_rows bounds the rows that a Python worker holds at a time, for wide rows. Files are as many as the data
    is large, not as many as there are cores.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lynceus-{uuid.uuid4().hex}"
    settings = {PARALLEL_FIRST: "false"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    with _settings:
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, now and then: only after that are shuffle files and broadcasts of finished steps deleted on the executors."""
    if time.monotonic() - _swept[0] > SWEEP_S:
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


def discard(df: DataFrame) -> None:
    """Delete the files of a `cut` that nothing reads any more."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
