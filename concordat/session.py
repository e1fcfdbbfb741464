"""Session settings the jobs are written for."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager, suppress
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookup joins (fact -> its section, citation -> its chunk) have a unique right
    # side, so the skew split below is what spreads a hot left key over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs about a millisecond for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "concordat", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, one in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def _remove(files, path) -> None:
    with suppress(Exception):  # the program ends; the machine behind it may have gone first
        files.delete(path, True)


#: Spark then removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For rows with many computed columns, dealt by keys that grow with the input.  The JVM compiles no method of more than
#: 8,000 bytes, and interprets it; above that Spark runs the operators one by one.  Shuffles start with many partitions, which
#: the adaptive plan puts together by size, so that tasks grow in number and not in memory.
WIDE = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """Queries run inside have these settings."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@cache
def _own_folder(spark: SparkSession, base: str) -> str:
    """This session's folder, removed when the program ends."""
    folder = f"{base.rstrip('/')}/concordat-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name below this session's part of the shared checkpoint folder."""
    return f"{_own_folder(spark, ensure_checkpoint_dir(spark))}/{uuid.uuid4().hex[:12]}-{name}"


def settle(rows: DataFrame, name: str = "rows", settings: dict[str, str] | None = None) -> DataFrame:
    """Write rows to the shared checkpoint folder as Parquet and read them back.

    Used where several stages read the same result: it is computed once, survives the
    loss of executors, and later stages prune columns and know its size.  What was shuffled for
    it is not read again, and goes.  `settings` hold while the rows are written.  Much of a register is hashes in hex
    digits, which find no copies of themselves; zstd packs the digits too.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    with _set(spark, {CLEANUP: "true", **(settings or {})}):
        rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
