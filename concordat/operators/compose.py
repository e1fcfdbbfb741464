"""The register's sections and their incremental maintenance.

A section is a header, kept as JSON, and the values it supersedes and observes, one row each
(its parts), whatever their number.  Its content hash covers the header and, through a
digest that combines, every part; so no task ever holds a whole section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.functions.digests import set_digest
from concordat.operators.reconcile import contributions, earliest

COMPOSER_VERSION = "1"
NO_PARTS = "0:0:0"  # the digest of a section without parts

SECTION = ["section_key", "content", "content_hash", "fact_digest",
           "composer_version", "carried_forward", "prev_version_id", "version_id"]


def _json(**fields: Column) -> Column:
    """Canonical JSON: sorted keys, nulls kept, no blanks."""
    pairs = [value.alias(name) for name, value in sorted(fields.items())]
    return F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"})


def section_facts(views: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The dependency map: which facts each section rests on."""
    return contributions(views, resolutions).select("section_key", "fact_id", "role")


def section_parts(views: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The superseded and observed values of each section, one row each.

    Reading order is `part`: superseded values from oldest to newest, observed ones in order
    of statement.
    """
    several = resolutions.filter("n_facts > 1 OR n_observed > 0")
    members = contributions(views, several).filter(F.col("role") != "governing")
    superseded = F.col("role") == "superseded"
    part = F.concat_ws(
        "/", "role", T.iso(F.when(superseded, F.coalesce("effective_date", earliest()))),
        F.lpad((F.when(superseded, F.col("precedence")) + 1).cast("string"), 3, "0"),
        F.lpad(F.col("fact_seq").cast("string"), 20, "0"),
    )
    return members.select("section_key", part.alias("part"), F.col("value_raw").alias("content"))


def section_plans(views: DataFrame, resolutions: DataFrame) -> DataFrame:
    """G1: one row per section with the canonical header and the hash over header and parts."""
    g = F.col("governing")
    header = dict(
        vendor=F.col("vendor"), term=F.col("predicate"), scope=F.col("scope_key"),
        value=g["value_raw"], normalized=g["unit"], effective_date=T.iso(g["effective_date"]),
        governing_source=g["document_kind"], status=F.col("status"),
    )
    digests = section_parts(views, resolutions).groupBy("section_key").agg(
        set_digest(F.concat_ws(" ", "part", T.content_hash("content"))).alias("parts_digest"))
    whole = F.concat_ws(" ", T.content_hash("content"), F.coalesce("parts_digest", F.lit(NO_PARTS)))
    return (
        resolutions.join(digests, "section_key", "left")
        .withColumn("content", _json(**header))
        .select("section_key", "vendor", F.col("predicate").alias("term"), "content",
                F.sha2(whole, 256).alias("content_hash"), "fact_digest", "n_facts",
                g["fact_id"].alias("governing_fact_id"))
    )


def plan_recomposition(sections: DataFrame, previous: DataFrame,
                       version: str = COMPOSER_VERSION) -> DataFrame:
    """Carry a section when its facts and the logic behind it are unchanged.

    `sections` are the resolutions: their fact digests decide, nothing is composed yet.
    `previous` holds the section versions of the previous run; no rows means a full run.
    """
    before = previous.select(
        "section_key", *[F.col(c).alias(f"prev_{c}") for c in
                         ("version_id", "content", "content_hash", "fact_digest", "composer_version")]
    )
    reason = (
        F.when(F.col("prev_version_id").isNull(), "new")
        .when(~F.col("prev_composer_version").eqNullSafe(F.lit(version)), "logic changed")
        .when(~F.col("prev_fact_digest").eqNullSafe(F.col("fact_digest")), "facts changed")
    )
    return (
        sections.select("section_key", "fact_digest").join(before, "section_key", "left")
        .withColumn("reason", reason)
        .withColumn("carried_forward", F.col("reason").isNull())
    )


def rederived(resolutions: DataFrame, plan: DataFrame) -> DataFrame:
    """The resolutions whose sections have to be composed."""
    return resolutions.join(plan.filter(~F.col("carried_forward")).select("section_key"), "section_key", "left_semi")


def version_id(run_id: Column) -> Column:
    return F.sha2(F.concat_ws("\n", run_id, F.col("section_key")), 256)


def apply_plan(plan: DataFrame, composed: DataFrame, run_id: str, version: str = COMPOSER_VERSION) -> DataFrame:
    """This run's versions; a carried section is the previous one, copied.

    `composed` holds the plans (G1) of the sections that are not carried.
    """
    fresh = composed.select("section_key", "content", "content_hash")

    def chosen(name: str) -> Column:
        return F.when(F.col("carried_forward"), F.col(f"prev_{name}")).otherwise(F.col(name))

    return plan.join(fresh, "section_key", "left").select(
        "section_key",
        *[chosen(c).alias(c) for c in ("content", "content_hash", "fact_digest")],
        F.when(F.col("carried_forward"), F.col("prev_composer_version"))
        .otherwise(F.lit(version)).alias("composer_version"),
        "carried_forward", "prev_version_id",
        version_id(F.lit(run_id)).alias("version_id"),
    )


CONTENT = ("vendor string, term string, scope string, value string, normalized string, "
           "effective_date string, governing_source string, status string")


def claim_text(row: Column) -> Column:
    source = F.coalesce(F.concat(F.lit(", per the "), row["governing_source"]), F.lit(""))
    since = F.coalesce(F.concat(F.lit(", effective "), row["effective_date"]), F.lit(""))
    return F.when(
        row["value"].isNull(),
        F.concat(row["vendor"], F.lit(": no supported value for "), row["term"], F.lit(".")),
    ).otherwise(
        F.concat(row["vendor"], F.lit(": "), row["term"], F.lit(" is "), row["value"],
                 source, since, F.lit("."))
    )


def claims_for(versions: DataFrame, previous_claims: DataFrame) -> DataFrame:
    """One claim per section; carried sections keep the claim they had."""
    claim_id = F.sha2(F.concat_ws("\n", F.lit("claim"), "version_id"), 256)
    row = F.from_json("content", CONTENT)
    fresh = versions.filter(~F.col("carried_forward")).withColumn("row", row).select(
        claim_id.alias("claim_id"), "section_key", claim_text(F.col("row")).alias("text"),
        F.when(F.col("row.value").isNotNull(), "supported").otherwise("unsupported").alias("status"),
    )
    kept = versions.filter("carried_forward").join(
        previous_claims.select("section_key", "text", "status"), "section_key"
    ).select(claim_id.alias("claim_id"), "section_key", "text", "status")
    return fresh.unionByName(kept)


def citations_for(claims: DataFrame, versions: DataFrame, facts_of_sections: DataFrame,
                  previous_citations: DataFrame) -> DataFrame:
    """The facts each claim cites; carried claims keep their citations.

    `previous_citations` has section_key and fact_id.
    """
    of_claim = claims.select("claim_id", "section_key").join(
        versions.select("section_key", "carried_forward"), "section_key"
    )
    fresh = facts_of_sections.select("section_key", "fact_id").join(
        of_claim.filter(~F.col("carried_forward")), "section_key"
    )
    kept = previous_citations.select("section_key", "fact_id").join(
        of_claim.filter("carried_forward"), "section_key"
    )
    columns = ["claim_id", "section_key", "fact_id"]
    return fresh.select(*columns).unionByName(kept.select(*columns))


def plan_summary(versions: DataFrame) -> DataFrame:
    """Sections in total, rederived and carried, of a run's versions or of its plan."""
    return versions.agg(
        F.count("*").alias("sections_total"),
        F.count_if(~F.col("carried_forward")).alias("sections_rederived"),
        F.count_if("carried_forward").alias("sections_carried_forward"),
    )


def previous_run(runs: DataFrame) -> DataFrame:
    """The latest completed run of each corpus."""
    return runs.filter(F.col("status") == "completed").groupBy("corpus").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")
    )
