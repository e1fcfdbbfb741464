"""Continuous maintenance: files arrive, the register follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.ingest import partition_readable
from concordat.plans.register_run import RunResult, start_run
from concordat.sources.inbox import diff_snapshot, is_triggered, known_hashes, listing, present_paths, read_inbox_stream, scan_documents
from concordat.sources.tables import Tables


def run_if_changed(tables: Tables, corpus: str, inbox: str, run_id: str, **options) -> RunResult | None:
    """One look at the folder: a run over all of it when something arrived or was edited.

    What was seen before is what has been ingested, never a listing, so a restart finds
    nothing new and a fresh installation finds everything.  This also notices files
    edited in place, which a file stream does not deliver twice.
    """
    present = scan_documents(tables.spark, inbox)
    readable, _ = partition_readable(present)
    seen = known_hashes(tables.read("documents", corpus))
    if not is_triggered(diff_snapshot(listing(readable), seen)).first().triggered:
        return None
    return start_run(tables, corpus, run_id, present, **options)


def start_register_stream(
    tables: Tables, corpus: str, inbox: str, checkpoint: str, *,
    on_result: Callable[[RunResult], None] | None = None, once: bool = False, **options,
) -> StreamingQuery:
    """Run the corpus for every batch of new paths.

    A batch hands its own documents to the run, and of the rest of the folder only the paths: what
    they held is known, so no other file is opened.  Documents whose path is gone leave the register.  The
    run id comes from the batch number, so a replayed batch replaces its own rows.
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        readable, _ = partition_readable(batch.withColumn("corpus", F.lit(corpus)))
        known = tables.read("documents", corpus).select("sha256")
        if readable.join(known, "sha256", "left_anti").isEmpty():
            return
        result = start_run(tables, corpus, f"batch-{number:08d}", batch, present=present_paths(tables.spark, inbox), **options)
        if on_result:
            on_result(result)

    writer = (
        read_inbox_stream(tables.spark, inbox).writeStream
        .foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
