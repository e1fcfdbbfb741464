"""What each document is, and which ones a human must say it for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import (
    CLASSIFY_THRESHOLD,
    DOCUMENT_KINDS,
    EFFECT_GOVERNS,
    EFFECT_OBSERVES,
    KIND_DESCRIPTIONS,
    NON_GOVERNING_KINDS,
)
from concordat.functions import text as T
from concordat.functions.values import parse_date

ANSWER = ("kind string, vendor string, document_date string, confidence string, "
          "fits_kind string, reasoning string, broken string")


def parse_classifications(responses: DataFrame) -> DataFrame:
    """Kind, vendor, date and confidence of each response; unusable ones are unknown."""
    row = F.from_json("response_text", ANSWER, {"columnNameOfCorruptRecord": "broken"})
    # fits_kind must be the JSON value true at the top, not a string that reads so or a nested one.
    stated = F.try_variant_get(F.try_parse_json("response_text"), "$.fits_kind", "variant")
    fits = F.coalesce((F.schema_of_variant(stated) == "BOOLEAN") & F.try_variant_get(stated, "$", "boolean"), F.lit(False))
    r = F.col("_r")
    unreadable = r.isNull() | r["broken"].isNotNull()
    # A missing kind is the kind unknown, which is a known kind; its confidence stands.
    kind = F.coalesce(r["kind"], F.lit("unknown"))
    known = kind.isin(*DOCUMENT_KINDS)
    number = F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0))
    number = F.when(F.isnan(number), 0.0).otherwise(number)
    state = F.when(unreadable, "unreadable").when(~known, "unrecognised").otherwise("ok")
    ok = F.col("_state") == "ok"
    return (
        responses.withColumn("_r", row).withColumn("_state", state)
        .select(
            *[c for c in responses.columns if c != "response_text"],
            F.when(ok, kind).otherwise("unknown").alias("kind"),
            F.when(F.col("_state") == "unreadable", "")
            .otherwise(F.coalesce(T.strip(r["vendor"]), F.lit(""))).alias("vendor"),
            F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.0).alias("confidence"),
            F.when(F.col("_state") == "unreadable", "classifier returned unparseable output")
            .when(F.col("_state") == "unrecognised",
                  F.concat(F.lit("classifier returned unrecognised kind "), T.quoted(kind)))
            .otherwise(F.coalesce(T.strip(r["reasoning"]), F.lit(""))).alias("reasoning"),
            F.when(ok, parse_date(T.strip(r["document_date"]))).alias("document_date"),
            F.when(ok, fits).otherwise(True).alias("fits_kind"),
        )
    )


def names_organisation(text: Column | str, organisation: str | None) -> Column:
    """Whether the whole text names us; NULL where no name is configured."""
    if not (organisation or "").strip():
        return F.lit(None).cast("boolean")
    needle = " ".join(organisation.split()).casefold()
    return T.fold_case(T.squash(F.coalesce(T.col(text), F.lit("")))).contains(needle)


def escalation_reason(threshold: float, organisation: str | None) -> Column:
    unnamed = ~F.coalesce(names_organisation("text", organisation), F.lit(True))
    return (
        F.when(F.col("kind") == "unknown", "the classifier declined to identify this document")
        .when(~F.col("fits_kind"), F.concat(
            F.lit("the classifier reports "), T.quoted("kind"),
            F.lit(" is the nearest available kind rather than a description of this document")))
        .when(F.col("confidence") < threshold, F.concat(
            F.lit("confidence "), F.format_string("%.2f", "confidence"),
            F.lit(f" is below the {threshold} threshold")))
        .when(unnamed, F.lit(
            f"the document never names {organisation!r}, so it may be an agreement between "
            f"other parties rather than one of ours"))
    )


def route_escalations(classified: DataFrame, threshold: float = CLASSIFY_THRESHOLD,
                      organisation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, escalated with the reason).  `text` is needed with an organisation."""
    reasoned = classified.withColumn("reason", escalation_reason(threshold, organisation))
    return (reasoned.filter(F.col("reason").isNull()).drop("reason"),
            reasoned.filter(F.col("reason").isNotNull()))


def escalation_findings(escalated: DataFrame) -> DataFrame:
    return escalated.select(
        "document_id", F.lit("medium").alias("severity"), F.lit("document").alias("target_kind"),
        F.concat(
            T.basename("uri"), F.lit(": needs a human to say what it is — "), F.col("reason"),
            F.lit(". Proposed "), T.quoted("kind"), F.lit(" at confidence "),
            F.format_string("%.2f", "confidence"), F.lit(". Model's reasoning: "), F.col("reasoning"),
        ).alias("explanation"),
    )


def apply_human_kinds(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """C4: a known kind is taken with full confidence, any other answer is ignored."""
    chosen = F.lower(T.strip("answer"))
    accepted = answers.select("document_id", chosen.alias("_chosen")).filter(
        F.col("_chosen").isin(*DOCUMENT_KINDS)
    )
    return documents.join(accepted, "document_id", "left").withColumns({
        "kind": F.coalesce("_chosen", "kind"),
        "kind_confidence": F.when(F.col("_chosen").isNotNull(), 1.0).otherwise(F.col("kind_confidence")),
    }).drop("_chosen")


def escalation_options(escalated: DataFrame) -> DataFrame:
    """The six possible answers for each document and what each of them does."""
    options = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(kind not in NON_GOVERNING_KINDS).alias("governs"),
            F.lit(KIND_DESCRIPTIONS[kind]).alias("description"),
            F.lit(EFFECT_OBSERVES if kind in NON_GOVERNING_KINDS else EFFECT_GOVERNS).alias("effect"),
        ) for kind in DOCUMENT_KINDS
    ])
    return escalated.select("document_id", F.inline(options))
