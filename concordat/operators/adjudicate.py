"""Verdicts of an outside judge on the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import NOTE_NO_VERDICT, NOTE_UNPARSEABLE, NOTE_WITHHELD, SEVERITIES
from concordat.functions import text as T
from concordat.functions.direction import contradicts
from concordat.functions.numbering import with_index
from concordat.operators.conflicts import with_direction

BATCH = 100
ITEM = "struct<index:string,is_real_conflict:string,severity:string,explanation:string>"
ANSWER = f"verdicts array<{ITEM}>, broken string"


def batch_candidates(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """Candidates in batches for the judge: batch_id, and the index within the batch."""
    key = F.concat_ws("\n", "kind", F.col("a_fact_id").cast("string"), F.col("b_fact_id").cast("string"))
    numbered = with_index(candidates, [], key, "candidate_index")
    return numbered.withColumn(
        "batch_id", F.floor(F.col("candidate_index") / size).cast("bigint")
    ).withColumn("index", (F.col("candidate_index") % size).cast("int"))


def apply_verdicts(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """candidates (batch_id, index) with the verdicts of (batch_id, response_text)."""
    read = responses.withColumn(
        "_r", F.from_json("response_text", ANSWER, {"columnNameOfCorruptRecord": "broken"})
    ).select("batch_id", "_r", (F.col("_r").isNull() | F.col("_r.broken").isNotNull()).alias("_broken"))
    verdicts = (
        read.filter(~F.col("_broken"))
        .select("batch_id", F.posexplode_outer("_r.verdicts").alias("_pos", "_v"))
        .withColumn("index", F.col("_v.index").try_cast("double").cast("int"))
        .filter(F.col("index").isNotNull())
        .groupBy("batch_id", "index")
        .agg(F.max_by("_v", "_pos").alias("_v"))
    )
    joined = candidates.join(read.select("batch_id", "_broken"), "batch_id", "left").join(
        verdicts, ["batch_id", "index"], "left"
    )
    v = F.col("_v")
    broken = F.coalesce("_broken", F.lit(False))
    real = F.coalesce(F.lower(v["is_real_conflict"]) != "false", F.lit(True))
    given = T.strip(F.coalesce(T.none_if_empty(v["explanation"]), F.col("detail")))
    explanation = (
        F.when(broken, F.concat(F.col("detail"), F.lit(f" ({NOTE_UNPARSEABLE}.)")))
        .when(v.isNull(), F.concat(F.col("detail"), F.lit(f" {NOTE_NO_VERDICT}")))
        .otherwise(given)
    )
    judged = ~broken & v.isNotNull()
    return joined.withColumns({
        "judged": judged,
        "is_real_conflict": F.when(judged, real).otherwise(True),
        "severity": F.when(judged & v["severity"].isin(*SEVERITIES), v["severity"]).otherwise("medium"),
        "explanation": explanation,
    }).drop("_v", "_broken")


def check_explanations(judged: DataFrame) -> DataFrame:
    """an explanation that contradicts the computed direction is not shown."""
    withheld = F.col("judged") & contradicts(F.col("explanation"), F.col("sign"))
    computed = F.concat("direction", F.lit(" "), "detail", F.lit(f" {NOTE_WITHHELD}"))
    return (
        with_direction(judged)
        .withColumn("withheld", withheld)
        .withColumn("explanation", F.when(F.col("withheld"), computed).otherwise(F.col("explanation")))
    )


def merge_conflicts(judged: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new conflicts, findings, how many candidates were settled before)."""
    key = ["a_fact_id", "b_fact_id", "kind"]
    known = existing.select(*key, F.col("status").alias("_status"))
    joined = judged.join(known, key, "left")
    new = joined.filter(F.col("_status").isNull()).select(
        *key, "severity",
        F.when(F.col("is_real_conflict"), "open").otherwise("dismissed").alias("status"), "explanation",
    )
    settled = F.coalesce(F.col("_status") != "open", F.lit(False))
    findings = joined.filter(~settled & F.col("is_real_conflict")).select(
        *key, "severity", F.lit("conflict").alias("target_kind"),
        F.concat("subject", F.lit(" — "), "predicate", F.lit(": "), "explanation").alias("explanation"),
    )
    return new, findings, joined.agg(F.count_if(settled).alias("already_settled"))
