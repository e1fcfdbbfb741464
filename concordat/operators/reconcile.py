"""Facts in context, and which of them governs.

A group is one (vendor, term, scope).  A group can hold any share of all facts, so
nothing here gathers or sorts a group in one task: the governing fact comes from an
aggregate that combines on the map side, and the losing facts stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.fixed_values import ENGAGEMENT_KINDS
from concordat.functions import text as T
from concordat.functions import values as V
from concordat.functions.digests import digest_of, member
from concordat.functions.vocabulary import governed_term, governs, precedence

GROUP = ["subject_key", "predicate", "scope_id"]
TERM_GROUP = ["subject_key", "governed_predicate", "scope_id"]
def earliest() -> Column:
    """Undated facts rank before every dated one."""
    return F.lit("0001-01-01").cast("date")


# What later stages need to know about the fact that governs.
FACT_FIELDS = ["fact_id", "fact_seq", "subject", "value_raw", "magnitude", "unit",
               "effective_date", "document_id", "document_kind"]


#: What a group's state holds besides its key.
STATE = ["governing", "rank", "n_governing", "n_observed", "digest_0", "digest_1"]


def with_keys(facts: DataFrame) -> DataFrame:
    """Identity, rank and magnitude columns for facts already in context.

    Needs fact_id, fact_seq, document_id, document_kind, subject, predicate, value_raw,
    effective_date and scope.  `scope_id` is `scope_key` with '' for agreement-wide, so
    that it can be a plain equi-join key.
    """
    return (
        facts.withColumn("subject_key", T.subject_key("subject"))
        .withColumn("scope_key", T.scope_key("scope"))
        .withColumn("scope_id", F.coalesce("scope_key", F.lit("")))
        .withColumn("precedence", precedence("document_kind"))
        .withColumn("governs", governs("document_kind"))
        .withColumn("governed_predicate", governed_term("predicate"))
        .withColumn("magnitude", V.magnitude("predicate", "value_raw"))
        .withColumn("unit", F.when(F.col("magnitude").isNotNull(), V.unit_of("predicate")))
    )


def engagement_label(uri: Column | str) -> Column:
    words = T.strip(F.translate(T.file_stem(uri), "-_", "  "))
    return F.coalesce(T.none_if_empty(words), F.lit("engagement"))


def fact_views(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Each fact with the vendor, date, kind and scope its document gives it."""
    about = documents.select(
        "document_id",
        F.col("vendor").alias("_vendor"),
        F.col("kind").alias("_kind"),
        F.col("document_date").alias("_date"),
        "uri",
    )
    kind = F.coalesce("_kind", F.lit("unknown"))
    qualifier = T.none_if_empty(T.fold_case(T.strip("qualifier")))
    label = F.when(kind.isin(*ENGAGEMENT_KINDS), engagement_label("uri"))
    joined = (
        facts.join(about, "document_id", "left")
        .withColumn("document_kind", kind)
        .withColumn("subject", F.coalesce(T.none_if_empty("_vendor"), "subject"))
        .withColumn("effective_date", F.coalesce("effective_date", "_date"))
        .withColumn("scope", T.none_if_empty(F.concat_ws("::", label, qualifier)))
    )
    return with_keys(joined.drop("_vendor", "_kind", "_date", "uri"))


def spellings(views: DataFrame) -> DataFrame:
    """How often each spelling of a vendor is used; governing documents count double.  Weights add up."""
    return views.groupBy("subject_key", "subject").agg(
        F.sum(F.when(F.col("governs"), 2).otherwise(1)).cast("bigint").alias("weight")
    )


def merge_spellings(weights: DataFrame) -> DataFrame:
    merged = weights.groupBy("subject_key", "subject").agg(F.sum("weight").alias("weight"))
    return merged.filter("weight > 0")


def best_spellings(weights: DataFrame) -> DataFrame:
    """D3: one spelling per vendor."""
    shouted = (F.upper("subject") == F.col("subject")) & (F.lower("subject") != F.col("subject"))
    return weights.groupBy("subject_key").agg(
        F.max_by("subject", F.struct("weight", (~shouted).alias("calm"), "subject")).alias("vendor")
    )


def display_names(views: DataFrame) -> DataFrame:
    """D3: one spelling per vendor; governing documents count double."""
    return best_spellings(spellings(views))


def rank_order(date: str = "effective_date") -> Column:
    """Later date wins, then the weightier kind, then the later statement."""
    return F.struct(F.coalesce(date, earliest()).alias("on"), F.col("precedence"), F.col("fact_seq"))


def group_states(views: DataFrame) -> DataFrame:
    """One state per group, which merges with others: the governing fact, its rank, counts, digest sums."""
    fact = F.struct(*FACT_FIELDS)
    return views.groupBy(*GROUP).agg(
        F.max_by(F.when(F.col("governs"), fact), F.when(F.col("governs"), rank_order()))
        .alias("governing"),
        F.max(F.when(F.col("governs"), rank_order())).alias("rank"),
        F.count_if("governs").alias("n_governing"),
        F.count_if(~F.col("governs")).alias("n_observed"),
        *[F.coalesce(F.sum(member("fact_id", i)), F.lit(0)).cast("decimal(38,0)").alias(f"digest_{i}") for i in (0, 1)],
    )


def digest_states(views: DataFrame, *parts: str) -> DataFrame:
    """What the plan of a run asks of a group: the count and digest sums of its facts, also by some part of them."""
    return views.groupBy(*GROUP, *parts).agg(
        F.count("*").alias("n_facts"),
        *[F.coalesce(F.sum(member("fact_id", i)), F.lit(0)).cast("decimal(38,0)").alias(f"digest_{i}") for i in (0, 1)],
    )


def section_digests(states: DataFrame) -> DataFrame:
    """Sections with the digest of their facts, from digest states, which add up."""
    whole = states.filter(F.col("subject_key").isNotNull()).groupBy(*GROUP).agg(
        F.sum("n_facts").alias("n_facts"), *[F.sum(f"digest_{i}").cast("decimal(38,0)").alias(f"digest_{i}") for i in (0, 1)])
    return whole.select(F.concat_ws("::", "subject_key", "predicate", T.none_if_empty("scope_id")).alias("section_key"),
                        digest_of("n_facts", "digest_0", "digest_1").alias("fact_digest"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of the facts -> states of all of them."""
    return states.groupBy(*GROUP).agg(
        F.max_by("governing", "rank").alias("governing"), F.max("rank").alias("rank"),
        F.sum("n_governing").alias("n_governing"), F.sum("n_observed").alias("n_observed"),
        *[F.sum(f"digest_{i}").cast("decimal(38,0)").alias(f"digest_{i}") for i in (0, 1)],
    )


def resolve(states: DataFrame, names: DataFrame) -> DataFrame:
    """D4 of states and weighted spellings."""
    return (
        states.withColumn("scope_key", T.none_if_empty("scope_id"))
        .withColumn("section_key", F.concat_ws("::", "subject_key", "predicate", "scope_key"))
        .withColumn("status", F.when(F.col("governing").isNull(), "unsupported").otherwise("agreed"))
        .withColumn("n_superseded", F.greatest(F.col("n_governing") - 1, F.lit(0)))
        .withColumn("n_facts", F.col("n_governing") + F.col("n_observed"))
        .withColumn("fact_digest", digest_of("n_facts", "digest_0", "digest_1"))
        .drop("rank", "digest_0", "digest_1")
        .join(best_spellings(names), "subject_key")
    )


def reconcile(views: DataFrame) -> DataFrame:
    """One row per group with its governing fact and the make-up of the rest."""
    return resolve(group_states(views), spellings(views))


def contributions(views: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every fact with its section and role.

    The join has one row per group on the right, so a group that holds a large share
    of the facts is split over tasks by the adaptive skew join.
    """
    heads = resolutions.select(
        *GROUP, "section_key", "n_facts", F.col("governing.fact_id").alias("governing_fact_id")
    )
    role = (
        F.when(~F.col("governs"), "observed")
        .when(F.col("fact_id") == F.col("governing_fact_id"), "governing")
        .otherwise("superseded")
    )
    return views.join(heads, GROUP).withColumn("role", role)


def supersession(views: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Superseded fact -> the fact that governs in its place."""
    losing = contributions(views.filter("governs"), resolutions.filter("n_governing > 1"))
    return losing.filter(F.col("role") == "superseded").select(
        "section_key", F.col("fact_id").alias("superseded_fact_id"), "governing_fact_id"
    )


def values_in_force(views: DataFrame, group: list[str], asked: Column) -> DataFrame:
    """For every date on which a group has a fact that is asked about: the fact in force on that date.

    Facts first shrink to one row per group and day, so the window over a group never
    sees more rows than the calendar has days, however many facts the group holds.
    """
    dated = F.col("effective_date").isNotNull()
    eligible = F.col("governs") & dated
    fact = F.struct("precedence", "fact_seq", *[c for c in FACT_FIELDS if c != "fact_seq"])
    days = views.groupBy(*group, "effective_date").agg(
        F.max(F.when(eligible, fact)).alias("best"),
        F.min(F.struct("fact_seq", "subject")).alias("first"),
        F.coalesce(F.max(asked), F.lit(False)).alias("asked"),
    )
    whole = Window.partitionBy(*group)
    so_far = whole.orderBy("effective_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return days.select(
        *group, "effective_date", "asked",
        F.last("best", ignorenulls=True).over(so_far).alias("in_force"),
        F.min("first").over(whole)["subject"].alias("group_subject"),
    ).filter(dated & F.col("asked")).drop("asked")


def governing_at(views: DataFrame, probes: DataFrame) -> DataFrame:
    """The fact in force for each probe (group columns and probe_date)."""
    asked = probes.select(*GROUP, F.col("probe_date").alias("effective_date")).distinct()
    empty = asked
    for field in views.schema:
        if field.name not in empty.columns:
            empty = empty.withColumn(field.name, F.lit(None).cast(field.dataType))
    marked = views.filter("governs").unionByName(
        empty.withColumn("governs", F.lit(False)).select(*views.columns)
    )
    found = values_in_force(marked, GROUP, ~F.col("governs")).withColumnRenamed("effective_date", "probe_date").drop(
        "group_subject"
    )
    return probes.join(found, [*GROUP, "probe_date"], "left")
