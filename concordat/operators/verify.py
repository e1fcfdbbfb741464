"""Every claim against its source passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.session import WIDE, settle


def value_present(value: Column, passage: Column) -> Column:
    """Exactly; else by its digits, trailing zeros aside; else, without digits, as words."""
    digits = F.regexp_replace(value, r"\P{Nd}", "")
    there = F.regexp_replace(passage, r"\P{Nd}", "")
    trimmed = F.coalesce(T.none_if_empty(F.rtrim(digits, F.lit("0"))), digits)
    words = F.lower(T.squash(passage)).contains(F.lower(T.squash(value)))
    return passage.contains(value) | F.when(digits == "", words).otherwise(
        there.contains(digits) | there.contains(trimmed)
    )


def _judged_facts(facts: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Every fact, with the reason why no citation can rest on it: fact_id, reason, detail; NULL where one can.

    A passage is dropped where it is met, so only what its fact says of itself moves on to the documents.
    """
    looked_up = (
        facts.select("fact_id", "predicate", "value_raw", "chunk_id", "document_id")
        .join(chunks.select("chunk_id", F.col("text").alias("_passage")), "chunk_id", "left")
        .select("fact_id", "predicate", "value_raw", "document_id", F.col("chunk_id").isNull().alias("_no_chunk"),
                F.col("_passage").isNull().alias("_no_passage"),
                value_present(F.col("value_raw"), F.col("_passage")).alias("_present"))
        .join(documents.select("document_id", F.col("uri").alias("_uri")), "document_id", "left")
    )
    lost_source = F.col("_no_passage") | F.col("_uri").isNull()
    stated = F.concat(F.col("predicate"), F.lit("="), T.quoted("value_raw"))
    reason = (
        F.when(F.col("_no_chunk"), "unverifiable_citation")
        .when(lost_source, "dangling_citation")
        .when(~F.col("_present"), "citation_does_not_resolve")
    )
    detail = (
        F.when(F.col("_no_chunk"), F.concat(F.lit("Fact "), stated, F.lit(
            " has no chunk recorded, so its citation cannot be re-checked against the source.")))
        .when(lost_source, F.concat(F.lit("Fact "), stated, F.lit(
            " cites a chunk or document that no longer exists.")))
        .otherwise(F.concat(
            F.lit("Claim cites "), stated, F.lit(" from "), F.col("_uri"),
            F.lit(", but that value no longer appears in the cited passage. "
                  "The source changed after the claim was made.")))
    )
    return looked_up.select("fact_id", reason.alias("reason"), F.when(reason.isNotNull(), detail).alias("detail"))


def verify_run(claims: DataFrame, citations: DataFrame, facts: DataFrame,
               chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per failure.

    facts: fact_id, predicate, value_raw, chunk_id, document_id; chunks: chunk_id, text;
    documents: document_id, uri.  Each lookup has a unique right side.  What is wrong with a citation is wrong with its
    fact: facts are judged by themselves and settled, so a citation moves once, and no passage or document
    beside it.  A claim's citations lie together, so their claim is named once a task before it moves.
    """
    uncited = (
        claims.filter(F.col("status") == "supported")
        .join(citations.select("claim_id").distinct(), "claim_id", "left_anti")
        .select(
            "claim_id", "section_key", F.lit(None).cast(facts.schema["fact_id"].dataType).alias("fact_id"),
            F.lit("uncited_claim").alias("reason"),
            F.concat(F.lit("Claim asserts "), T.quoted("text"), F.lit(
                " but carries no citation. A supported claim without evidence is an invented one."
            )).alias("detail"),
        )
    )
    judged = settle(_judged_facts(facts, chunks, documents), "judged_facts", WIDE)
    cited = citations.select("claim_id", "section_key", "fact_id").join(judged.withColumn("_fact", F.lit(True)), "fact_id", "left")
    lost_fact = F.col("_fact").isNull()
    failed = cited.filter(lost_fact | F.col("reason").isNotNull()).select(
        "claim_id", "section_key", "fact_id", F.when(lost_fact, "dangling_citation").otherwise(F.col("reason")).alias("reason"),
        F.when(lost_fact, F.concat(
            F.lit("Claim cites fact "), F.col("fact_id").cast("string"),
            F.lit(" which no longer exists. The supporting evidence was removed after the claim was made.")))
        .otherwise(F.col("detail")).alias("detail"))
    return failed.unionByName(uncited)


def verification_findings(failures: DataFrame) -> DataFrame:
    return failures.select(
        "claim_id", "fact_id", F.lit("high").alias("severity"), F.lit("verification").alias("target_kind"),
        F.concat(F.lit("["), "reason", F.lit("] "), "section_key", F.lit(": "), "detail")
        .alias("explanation"),
    )


def verification_summary(claims: DataFrame, citations: DataFrame, failures: DataFrame) -> DataFrame:
    """The figures the commit gate looks at."""
    counts = (
        claims.agg(F.count("*").alias("n")).select(F.lit("claims_checked").alias("k"), "n")
        .unionByName(citations.agg(F.count("*").alias("n")).select(F.lit("citations_checked").alias("k"), "n"))
        .unionByName(failures.agg(F.count("*").alias("n")).select(F.lit("failures").alias("k"), "n"))
    )
    figure = lambda k: F.max(F.when(F.col("k") == k, F.col("n"))).alias(k)
    return counts.agg(figure("claims_checked"), figure("citations_checked"), figure("failures")) \
        .withColumn("passed", F.col("failures") == 0)
