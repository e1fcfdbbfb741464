"""Findings, verdicts on them, and what carries over to the next run (K1-K6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.numbering import with_index

STAGES = ("ingest", "classify", "extract", "adjudicate", "examine", "verify")
FINDING = ["stage", "finding_key", "severity", "target_kind", "explanation"]


def staged(findings: DataFrame, stage: str, *key: str) -> DataFrame:
    """Findings of one stage with a key that is unique within the stage."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (*key, "explanation")]
    return findings.select(
        F.lit(stage).alias("stage"), F.sha2(F.concat_ws("\n", *parts), 256).alias("finding_key"),
        "severity", "target_kind", "explanation",
    )


def assemble_findings(*stages: DataFrame) -> DataFrame:
    """K1: the findings of a run in stage order, numbered from 0."""
    every = reduce(DataFrame.unionByName, [s.select(*FINDING) for s in stages])
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    ranked = every.withColumn("_stage", order)
    return with_index(ranked, [], F.concat_ws("\n", "stage", "finding_key"), "finding_index",
                      first=["_stage"]).drop("_stage")


def commit_decisions(findings: DataFrame, decisions: DataFrame,
                     actor: str = "human") -> tuple[DataFrame, DataFrame]:
    """K2: (findings with their status, one decision per finding).

    No verdict means approved; anything but approved means rejected.  Rejected findings stay.
    """
    given = decisions.select("finding_index", F.col("verdict").alias("_verdict"))
    verdict = F.when(F.coalesce("_verdict", F.lit("approved")) == "approved", "approved").otherwise("rejected")
    closed = findings.join(given, "finding_index", "left").withColumn("status", verdict).drop("_verdict")
    log = closed.select("finding_index", F.lit("finding").alias("kind"),
                        F.col("status").alias("verdict"), F.lit(actor).alias("actor"))
    return closed, log


def prior_verdicts(pending: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """K3: the newest verdict ever given on a byte-identical explanation."""
    newest = (
        decisions.filter(F.col("kind") == "finding")
        .join(findings.select("finding_id", "explanation"), "finding_id")
        .groupBy("explanation")
        .agg(F.max_by("verdict", F.struct("created_at", "decision_id")).alias("prior_verdict"))
    )
    return pending.join(newest, "explanation", "left")


def explanation_hash() -> Column:
    return F.sha2(F.coalesce("explanation", F.lit("")), 256)


def hash_prefix(name: str = "explanation_hash") -> Column:
    """The partition of the verdict index that holds a hash."""
    return F.left(name, F.lit(2))


def verdict_rows(findings: DataFrame, log: DataFrame) -> DataFrame:
    """What a commit adds to the verdict index: a row per decision (decision_id, finding_id, verdict, created_at)."""
    rows = log.select("decision_id", "finding_id", "verdict", "created_at").join(
        findings.select("finding_id", explanation_hash().alias("explanation_hash")), "finding_id")
    return rows.drop("finding_id").withColumn("prefix", hash_prefix())


def indexed_verdicts(pending: DataFrame, index: DataFrame) -> DataFrame:
    """K3 by the index: `prior_verdict` is the newest verdict on the same explanation, from its hash alone."""
    newest = index.groupBy("explanation_hash").agg(F.max_by("verdict", F.struct("created_at", "decision_id")).alias("prior_verdict"))
    return pending.withColumn("explanation_hash", explanation_hash()).join(newest, "explanation_hash", "left").drop("explanation_hash")


def carried_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (finding_index, verdict) with the verdicts that carried findings had before, where none is given."""
    before = findings.filter(F.col("prior_verdict").isNotNull()).select("finding_index", F.col("prior_verdict").alias("verdict"))
    given = decisions.select("finding_index", "verdict")
    return given.unionByName(before.join(given.select("finding_index"), "finding_index", "left_anti"))


def resolved_findings(parent: DataFrame, current: DataFrame) -> DataFrame:
    """K4: explanations of the parent run that are no longer raised."""
    raised = parent.filter(F.coalesce("explanation", F.lit("")) != "").select("explanation").distinct()
    return raised.join(current.select("explanation"), "explanation", "left_anti")


def review_queue(pending: DataFrame) -> DataFrame:
    """K5: what a reviewer is asked, the weightiest first; settled findings marked carried."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return (
        pending.withColumn("queue", F.when(F.col("prior_verdict").isNull(), "fresh").otherwise("carried"))
        .withColumn("severity_rank", rank)
        .orderBy(F.col("queue").desc(), "severity_rank", "finding_index")
    )


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("queue", "severity").agg(F.count("*").alias("findings"))


def decision_log(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """K6: every decision with the finding it was about."""
    return decisions.join(findings.select("finding_id", "severity", "explanation"), "finding_id").select(
        "decision_id", "verdict", "actor", "severity", "explanation", F.col("created_at").alias("decided_at")
    )
