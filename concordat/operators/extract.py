"""Facts out of extraction responses, each tied to its passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import (
    DANGLING,
    EXTRACT_ATTEMPTS,
    FREE_TEXT_TERMS,
    INSTRUCTION_MARKERS,
    TERMS_ONLY_FOR_KIND,
)
from concordat.functions import text as T
from concordat.functions import values as V
from concordat.functions.vocabulary import lookup, term_allowed
from concordat.operators import quotes

EXTRACTOR_VERSION = "1"
ITEM = ("struct<predicate:string,subject:string,value_raw:string,unit:string,effective_date:string,"
        "confidence:string,qualifier:string,quote:string>")
ANSWER = f"facts array<{ITEM}>, instruction_like_spans array<string>, broken string"
NO_QUOTE = "no quote supplied — a fact without a citation is not a fact"
NOT_FOUND = "quote does not appear in the source document"


def pending_documents(documents: DataFrame, facts: DataFrame,
                      version: str = EXTRACTOR_VERSION) -> tuple[DataFrame, DataFrame]:
    """(documents without facts of this extractor version, the facts to reuse)."""
    current = facts.filter(F.col("extractor_version") == version)
    pending = documents.join(current.select("document_id"), "document_id", "left_anti")
    return pending, current.join(documents.select("document_id"), "document_id", "left_semi")


def tidy_value(raw: Column) -> Column:
    """Sentence punctuation and unbalanced brackets off the ends of a value."""
    marks = F.lit(DANGLING)
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def once(text: Column) -> Column:
        text = F.btrim(text, marks)
        extra = count(text, ")") - count(text, "(")
        return (
            F.when(text.endswith(")") & (extra > 0), F.left(text, F.length(text) - 1))
            .when(text.startswith("(") & (extra < 0), F.substr(text, F.lit(2)))
            .otherwise(text)
        )

    # A round removes at most one bracket, so as many rounds as brackets reach the end.
    text = T.strip(F.coalesce(raw, F.lit("")))
    rounds = F.sequence(F.lit(0), count(text, "(") + count(text, ")"))
    return F.aggregate(rounds, text, lambda value, _: once(value))


def read_extractions(responses: DataFrame) -> DataFrame:
    """Each response as (document_id, usable, items, spans).

    Worth writing when several of the results below are wanted: the JSON is then read once.
    """
    row = F.from_json("response_text", ANSWER, {"columnNameOfCorruptRecord": "broken"})
    usable = F.coalesce(F.col("_r.broken").isNull() & F.col("_r.facts").isNotNull(), F.lit(False))
    return responses.withColumn("_r", row).select(
        "document_id", usable.alias("usable"), F.col("_r.facts").alias("items"),
        F.col("_r.instruction_like_spans").alias("spans"))


def split_extractions(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, rejections, spans, failed documents) of responses as read."""
    failed = read.filter(~F.col("usable")).select("document_id")
    good = read.filter("usable")
    items = good.select(
        # The outer form: the plain one would add a filter that parses every response twice.
        "document_id", F.posexplode_outer("items").alias("position", "f")
    ).filter(F.col("f").isNotNull()).withColumn("quote", F.coalesce(T.strip("f.quote"), F.lit("")))
    rejections = items.filter(F.col("quote") == "").select(
        "document_id", "position", F.coalesce("f.predicate", F.lit("?")).alias("predicate"),
        F.coalesce("f.value_raw", F.lit("")).alias("value_raw"), "quote", F.lit(NO_QUOTE).alias("reason"),
    )
    facts = items.filter(F.col("quote") != "").select(
        "document_id", "position", "f.predicate", "f.subject",
        tidy_value(F.col("f.value_raw")).alias("value_raw"),
        F.coalesce("f.value_raw", F.lit("")).alias("value_as_given"), "quote",
        F.coalesce(F.col("f.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        T.none_if_empty("f.unit").alias("unit"), T.none_if_empty("f.effective_date").alias("date_text"),
        T.none_if_empty(T.strip("f.qualifier")).alias("qualifier"),
    )
    spans = good.select("document_id", F.explode_outer("spans").alias("span")).filter(T.strip("span") != "")
    return facts, rejections, spans, failed


def parse_extractions(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, rejections, spans, failed documents) from (document_id, response_text)."""
    return split_extractions(read_extractions(responses))


# --- C9 -----------------------------------------------------------------------


def locate_quotes(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with char_start, char_end and chunk_ordinal, NULL where the quote is nowhere."""
    return quotes.locate(facts, chunks)


def split_located(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cited facts, rejected facts with the reason)."""
    rejected = located.filter(F.col("char_start").isNull()).drop("char_start", "char_end", "chunk_ordinal")
    return (located.filter(F.col("char_start").isNotNull()), rejected.withColumn("reason", F.lit(NOT_FOUND)))


def resolve_citations(facts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with char_start, char_end and chunk_ordinal, rejected facts)."""
    return split_located(locate_quotes(facts, chunks))


# --- C10-C14 --------------------------------------------------------------------


def _fact_finding(rows: DataFrame, explanation: Column) -> DataFrame:
    place = [c for c in ("position",) if c in rows.columns]
    return rows.select("document_id", *place, F.lit("low").alias("severity"),
                       F.lit("fact").alias("target_kind"), explanation.alias("explanation"))


def gate_terms(facts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts their document's kind may state, a low finding for each other fact)."""
    about = documents.select("document_id", F.col("kind").alias("_kind"), F.col("uri").alias("_uri"))
    checked = facts.join(about, "document_id", "left").withColumn("_ok", term_allowed("predicate", "_kind"))
    kinds = lookup(F.col("predicate"), {
        term: "[" + ", ".join(f"'{k}'" for k in sorted(kinds)) + "]"
        for term, kinds in TERMS_ONLY_FOR_KIND.items()
    })
    explanation = F.concat(
        T.basename("_uri"), F.lit(": dropped "), F.col("predicate"), F.lit(" ("), T.quoted("value_raw"),
        F.lit(") — only a document of kind "), kinds,
        F.lit(" states what was billed, and this one is a "), T.quoted("_kind"), F.lit("."),
    )
    return (checked.filter("_ok").drop("_ok", "_kind", "_uri"),
            _fact_finding(checked.filter("NOT _ok"), explanation))


def normalize_facts(facts: DataFrame) -> DataFrame:
    """C11: magnitude, unit, canonical text, and why a value has no magnitude."""
    stated_unit = F.col("unit") if "unit" in facts.columns else F.lit(None).cast("string")
    number = facts.withColumn("magnitude", V.magnitude("predicate", "value_raw")).withColumn(
        "unit", F.when(F.col("magnitude").isNotNull(), V.unit_of("predicate")).otherwise(stated_unit)
    )
    return number.withColumns({
        "value_norm": F.concat(V.number_text("magnitude"), F.lit(" "),
                               F.when(F.col("magnitude").isNotNull(), F.col("unit"))),
        "not_comparable_reason": V.not_comparable_reason("value_raw", "magnitude"),
    })


def unnormalised_findings(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """C11: a low finding for each numeric term without a magnitude."""
    bad = facts.filter(F.col("magnitude").isNull() & ~F.col("predicate").isin(*FREE_TEXT_TERMS))
    named = bad.join(documents.select("document_id", "uri"), "document_id")
    return _fact_finding(named, F.concat(
        T.basename("uri"), F.lit(": "), F.col("predicate"), F.lit(" value "), T.quoted("value_raw"),
        F.lit(" could not be normalized, so it cannot be compared against other documents."),
    ))


def normalization_coverage(facts: DataFrame) -> DataFrame:
    """Facts and comparable facts by document and term."""
    return facts.groupBy("document_id", "predicate").agg(
        F.count("*").alias("facts"), F.count_if(F.col("magnitude").isNotNull()).alias("comparable")
    )


def scan_instruction_text(chunks: DataFrame) -> DataFrame:
    """Chunks that hold a marker of text aimed at an automated reader."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.contains(m), F.lit(m)) for m in INSTRUCTION_MARKERS]))
    return chunks.select("document_id", "ordinal", F.explode_outer(hits).alias("marker")).filter(
        F.col("marker").isNotNull())


def span_findings(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """A high finding for each reported span."""
    return spans.join(documents.select("document_id", "uri"), "document_id").select(
        "document_id", F.lit("high").alias("severity"), F.lit("document").alias("target_kind"),
        F.concat(T.basename("uri"), F.lit(
            " contains text addressed at an automated system, which was reported and not acted on: "),
            T.quoted(F.left("span", F.lit(200)))).alias("explanation"),
    )


def rejection_findings(rejections: DataFrame, documents: DataFrame) -> DataFrame:
    """C14: a low finding for each fact without a resolvable quote."""
    named = rejections.join(documents.select("document_id", "uri"), "document_id")
    return _fact_finding(named, F.concat(
        T.basename("uri"), F.lit(": dropped "), F.col("predicate"), F.lit(" ("), T.quoted("value_raw"),
        F.lit(") — "), F.col("reason"),
    ))


def failure_findings(failed: DataFrame, documents: DataFrame) -> DataFrame:
    """A high finding for each document whose response was unusable."""
    return failed.join(documents.select("document_id", "uri"), "document_id").select(
        "document_id", F.lit("high").alias("severity"), F.lit("document").alias("target_kind"),
        F.concat(T.basename("uri"), F.lit(
            f" was skipped: extraction could not produce usable output after {EXTRACT_ATTEMPTS} "
            "attempts. No facts from this document are in the register.")).alias("explanation"),
    )
