"""One group with a third of all facts: whole results, and joins that split it."""

import pytest
from pyspark.sql import functions as F

from concordat.operators import compose, conflicts, reconcile
from concordat.session import settle

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "16",
}
N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    i = F.col("id")
    facts = spark.range(0, N, 1, 12).select(
        F.format_string("f%06d", i).alias("fact_id"), i.alias("fact_seq"), F.lit("hourly_rate").alias("predicate"),
        F.when(i % 3 == 0, "Hot Vendor").otherwise(F.concat(F.lit("Vendor "), (i % 997).cast("string"))).alias("subject"),
        F.concat(F.lit("$"), (1 + i % 50).cast("string")).alias("value_raw"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 7).cast("int")).alias("effective_date"),
        (i % 4000).alias("document_id"),
        F.when(i % 5 == 0, "invoice").otherwise("msa").alias("document_kind"), F.lit(None).cast("string").alias("scope"),
    )
    yield settle(reconcile.with_keys(facts))
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan_after(frame):
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString()


def test_contributions_are_whole_and_split(hot):
    rows, plan = plan_after(reconcile.contributions(hot, reconcile.reconcile(hot)).select("section_key", "fact_id", "role"))
    assert len(rows) == N and len({r.fact_id for r in rows}) == N
    assert "skew=true" in plan


def test_groups_combine_before_the_shuffle(hot):
    _, plan = plan_after(reconcile.reconcile(hot).select("section_key", "governing", "fact_digest"))
    assert "partial_max_by" in plan and "partial_sum" in plan
    assert "Window" not in plan and "collect_list" not in plan


def test_hot_section_has_every_entry_and_is_never_gathered(hot):
    r = reconcile.reconcile(hot)
    rows, plan = plan_after(compose.section_plans(hot, r).filter("section_key LIKE 'hot%'"))
    parts = compose.section_parts(hot, r).filter("section_key LIKE 'hot%'")
    assert rows[0].n_facts == N // 3 and parts.count() == N // 3 - 1 == parts.select("part").distinct().count()
    assert "collect_list" not in plan and "partial_sum" in plan


def test_violations_match_a_plain_count(hot):
    got, plan = plan_after(conflicts.as_of_violations(hot).select("a_fact_id", "b_fact_id"))
    in_force = (
        hot.filter("governs").groupBy("subject_key", "effective_date")
        .agg(F.max_by("magnitude", F.struct("precedence", "fact_seq")).alias("m"), F.max_by("fact_id", F.struct("precedence", "fact_seq")).alias("g"))
    )
    seen = hot.filter("NOT governs").select("subject_key", "document_id", "fact_seq", "fact_id", "magnitude", F.col("effective_date").alias("d"))
    last = seen.join(in_force, "subject_key").filter("effective_date <= d").groupBy("subject_key", "document_id", "fact_seq", "fact_id", "magnitude").agg(
        F.max_by("m", "effective_date").alias("m"), F.max_by("g", "effective_date").alias("g")).filter("m <> magnitude")
    want = last.groupBy("document_id", "subject_key").agg(F.min(F.struct("fact_seq", "fact_id", "g")).alias("x"))
    assert sorted((r.a_fact_id, r.b_fact_id) for r in got) == sorted((r.x.fact_id, r.x.g) for r in want.collect())


def test_disagreements_of_a_hot_group_stay_linear(hot):
    members = conflicts.disagreeing_facts(hot).count()
    rows = conflicts.equal_rank(hot).filter("subject = 'Hot Vendor'").select("a_fact_id", "b_fact_id").collect()
    hot_members = conflicts.disagreeing_facts(hot).filter("group_subject = 'Hot Vendor'").count()
    assert members >= hot_members > 5000 and len(rows) < hot_members
    assert len({f for r in rows for f in r}) == hot_members
