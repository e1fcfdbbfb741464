"""What several operators of this folder share."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Ready a session: workers can import this package from its folder, and Arrow batches suit long texts."""
    if spark.conf.get(_BATCH) == "10000":  # the default; a setting of the cluster's own stands
        spark.conf.set(_BATCH, "1000")
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's vocabulary lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about most_bytes together.

    A longer text makes a run of its own; no row is lost.  This bounds what a task holds
    besides its input, whatever the length of the rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def one_thread() -> None:
    """Spark runs a task per core; libraries inside a task take no further threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def joined_sha256(rows: DataFrame, keys: list[str], piece: str, separator: str, name: str) -> DataFrame:
    """SHA-256 of the pieces of every key, joined by the separator, as lowercase hex.

    Rows must lie together by key and in order within their partitions, as repartition and
    sortWithinPartitions leave them.  SHA-256 takes its input in order, so a key's pieces pass one
    task; it holds a batch of them at most.
    """
    schema = pa.schema([(k, _ARROW[rows.schema[k].dataType.simpleString()]) for k in keys] + [(name, pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            done = []
            for *one, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or one != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = one, hashlib.sha256()
                else:
                    digest.update(separator.encode())
                digest.update(text.encode())
            yield _columns(done, schema)
        if digest is not None:
            yield _columns([(*key, digest.hexdigest())], schema)

    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, piece).mapInArrow(hashed, ", ".join([*fields, f"{name} string"]))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
