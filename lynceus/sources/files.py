"""Tables of files, lines and artifacts, from folders or from rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import text as X
from lynceus.sources import config as C

MAX_BYTES = 10 * 1024 * 1024
#: Added to the ordinals of entries of a dot-named ignore file.
AFTER = 1_000_000
SENTINELS = {"skill": "SKILL.md", "agent": "AGENT.md"}
SUPPRESSION = T.StructType([T.StructField("artifact_id", T.StringType()), T.StructField("ordinal", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("rule", "file", "lines", "reason", "ticket"))])


def with_names(files: DataFrame) -> DataFrame:
    """Adds file_name, stem, ext_raw and ext (lower case) from path."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = lambda n: F.regexp_extract(n, r"(?s)\A.+\.([^.]*)\z", 1)
    stem = lambda n: F.when(ext(n) != "", F.expr("left(file_name, length(file_name) - length(ext_raw) - 1)")).otherwise(n)
    named = files.withColumn("file_name", name).withColumn("ext_raw", ext(F.col("file_name")))
    return named.withColumn("stem", stem(F.col("file_name"))).withColumn("ext", F.lower("ext_raw"))


def guarded(length: Column, content: Column) -> tuple[Column, Column]:
    """(text, read_error) of binary content: too large or not UTF-8 is an error, and then there is no text."""
    error = F.when(length > MAX_BYTES, F.concat(F.lit("file of "), length.cast("string"), F.lit(f" bytes exceeds {MAX_BYTES}"))).when(~F.is_valid_utf8(content.cast("string")), F.lit("not UTF-8"))
    return F.when(error.isNull(), content.cast("string")), error


def is_local(root: str) -> bool:
    return not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) or root.startswith("file:")


def walked(root: str) -> list[tuple[str, int]]:
    """(path, length) of all regular files below a local folder, hidden ones as well; symbolic links are not followed."""
    out, folders = [], [root]
    while folders:
        try:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        out.append((e.path, e.stat(follow_symlinks=False).st_size))
        except OSError:  # a folder that can't be listed holds no files for us
            continue
    return sorted(out)


def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, length) of all files below a folder of any store that Spark reads. Only names come to the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def read_files(names: DataFrame) -> DataFrame:
    """path, length, raw, failed of files given by path and length; those over the size limit are not read."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                raw = failed = None
                if length <= MAX_BYTES:
                    try:
                        if is_local(path):
                            with open(path.removeprefix("file:"), "rb") as f:
                                raw = f.read(MAX_BYTES + 1)
                        else:
                            store, inner = fs.FileSystem.from_uri(path)
                            with store.open_input_stream(inner) as f:
                                raw = f.read(MAX_BYTES + 1)
                        length = max(length, len(raw))
                    except OSError as e:
                        failed = f"can't be opened: {e.strerror or e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([raw], pa.binary()), pa.array([failed], pa.string())], names=["path", "length", "raw", "failed"])

    return names.mapInArrow(read, "path string, length long, raw binary, failed string")


def from_folder(spark: SparkSession, root: str, collection: bool = False) -> DataFrame:
    """Files below root, hidden ones as well. In a collection each folder right below root is an artifact, else root is one.

    The names of artifacts come from paths; contents over the size limit are never read. Spark's own file source reads
    visible files of other stores than local folders, where its scans push the limit down; it passes over names that begin with . or _.
    """
    if is_local(root):
        base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
        found = walked(base)
    else:
        found = listed(spark, root)
        base = re.sub(r"\A[A-Za-z0-9+.-]+:/+", "/", root).rstrip("/")
    kinds = "path string, length long"
    if is_local(root):
        raw = read_files(spark.createDataFrame(found, kinds))
    else:
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        failed = F.lit(None).cast("string").alias("failed")
        raw = seen.where(F.col("length") <= MAX_BYTES).select("path", "length", F.col("content").alias("raw"), failed)
        raw = raw.unionByName(seen.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("raw"), failed))
        raw = raw.unionByName(read_files(spark.createDataFrame(found, kinds).join(seen.select("path"), "path", "left_anti")))
    plain = F.regexp_replace("path", r"\A[a-zA-Z0-9+.-]+:/+", "/")
    inner = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    own = F.split_part(inner, F.lit("/"), F.lit(1)) if collection else F.lit(base.rsplit("/", 1)[-1])
    rel = F.regexp_replace(inner, r"\A[^/]*/", "") if collection else inner
    text, error = guarded(F.col("length"), F.col("raw"))
    rows = raw.select(own.alias("artifact_id"), plain.alias("path"), rel.alias("rel_path"), "length", F.when(F.col("failed").isNull(), text).alias("content"), F.coalesce("failed", error).alias("read_error"))
    return with_names(rows.where(F.contains(inner, F.lit("/"))) if collection else rows)


def from_rows(rows: DataFrame, artifact: Column, path: Column, content: Column) -> DataFrame:
    """Rows of a table as files; over-long contents are read errors like those of files."""
    length = F.octet_length(content)
    error = F.when(length > MAX_BYTES, F.concat(F.lit("file of "), length.cast("string"), F.lit(f" bytes exceeds {MAX_BYTES}")))
    made = rows.select(artifact.cast("string").alias("artifact_id"), path.alias("path"), path.alias("rel_path"), length.cast("long").alias("length"), F.when(error.isNull(), content).alias("content"), error.alias("read_error"))
    return with_names(made)


def lines_of(files: DataFrame) -> DataFrame:
    """A row for each line of the files that could be read, numbered from 1."""
    kept = files.where(F.col("content").isNotNull())
    each = kept.select("artifact_id", "path", "file_name", "stem", "ext", "ext_raw", F.posexplode(X.lines(F.col("content"))).alias("p", "line"))
    return each.select("artifact_id", "path", "file_name", "stem", "ext", "ext_raw", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def artifacts_of(files: DataFrame, mode: str) -> DataFrame:
    """Artifacts whose root holds the sentinel file of the mode, in the order of their names."""
    return files.where((F.col("rel_path") == SENTINELS[mode])).select("artifact_id").distinct().orderBy("artifact_id")


def hidden_suppressions(spark: SparkSession, root: str, collection: bool = False) -> DataFrame:
    """Entries of the dot-named ignore files of artifacts alone."""
    return suppressions_of(from_folder(spark, root, collection).where(F.col("rel_path") == f".{C.IGNORE_NAME}"))


def suppressions_of(files: DataFrame) -> DataFrame:
    """Entries of the ignore files at artifacts' roots, with or without a dot in front; those without come first."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"artifact_id": a, **e, "ordinal": e["ordinal"] + (AFTER if p.startswith(".") else 0)} for a, p, t in zip(pdf.artifact_id, pdf.rel_path, pdf.content, strict=True) for e in C.suppressions(t)]
            yield pd.DataFrame(rows, columns=SUPPRESSION.names).astype({"ordinal": "int32"})

    names = (C.IGNORE_NAME, f".{C.IGNORE_NAME}")
    return files.where(F.col("rel_path").isin(*names) & F.col("content").isNotNull()).select("artifact_id", "rel_path", "content").mapInPandas(read, SUPPRESSION)
