"""A folder of documents: scan, stream, and what changed in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.fixed_values import MIME_OF_SUFFIX
from concordat.functions import text as T
from concordat.functions.vocabulary import lookup

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
# File suffixes are matched without regard to case.
ANY_CASE = "*.{" + ",".join(
    "".join(f"[{c.lower()}{c.upper()}]" for c in s.lstrip(".")) for s in sorted(MIME_OF_SUFFIX)) + "}"


def _as_documents(files: DataFrame) -> DataFrame:
    suffix = T.suffix("path")
    return files.select(
        F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"),
        lookup(suffix, MIME_OF_SUFFIX).alias("mime"),
        # A PDF's text is made elsewhere and joined by content hash.
        F.when(suffix != ".pdf", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.col("path").alias("arrival"),
    )


def scan_documents(spark: SparkSession, path: str, every_file: bool = False) -> DataFrame:
    """A1: the documents of a folder with hash of their bytes, mime and text."""
    reader = spark.read.format("binaryFile")
    if not every_file:
        reader = reader.option("pathGlobFilter", ANY_CASE)
    return _as_documents(reader.load(path))


def present_paths(spark: SparkSession, path: str) -> DataFrame:
    """The paths (uri) of the documents in a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ANY_CASE).load(path)
    return files.select(F.col("path").alias("uri"))


def read_inbox_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """The same as a stream of new paths."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("pathGlobFilter", ANY_CASE).option("maxFilesPerTrigger", max_files).load(path)
    )
    return _as_documents(files)


def listing(documents: DataFrame) -> DataFrame:
    return documents.select(T.basename("uri").alias("name"), "sha256")


def known_hashes(documents: DataFrame, corpus: str | None = None) -> DataFrame:
    """Name and hash of everything a corpus has ingested."""
    rows = documents if corpus is None else documents.filter(F.col("corpus") == corpus)
    return listing(rows)


def diff_snapshot(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Names added, modified or removed, by content hash.

    A name that occurs with several hashes in `seen` counts as modified only if the
    current hash is none of them.
    """
    now = current.groupBy("name").agg(F.max("sha256").alias("sha256"))
    before = seen.select("name", "sha256").distinct()
    names = before.select("name").distinct().withColumn("_seen", F.lit(True))
    same = before.withColumn("_same", F.lit(True))
    state = (
        F.when(F.col("sha256").isNull(), "removed")
        .when(F.col("_seen").isNull(), "added")
        .when(F.col("_same").isNull(), "modified")
    )
    return (
        now.join(names, "name", "full_outer").join(same, ["name", "sha256"], "left")
        .select("name", state.alias("state")).filter(F.col("state").isNotNull())
    )


def is_triggered(diff: DataFrame) -> DataFrame:
    """Only arrivals and edits start a run; a removal does not."""
    return diff.agg(F.coalesce(F.bool_or(F.col("state") != "removed"), F.lit(False)).alias("triggered"))
