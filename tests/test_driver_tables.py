"""Inputs derived from the given tables."""

from pathlib import Path

from pyspark.sql import functions as F

from concordat.operators import rules
from concordat.operators.reconcile import reconcile, with_keys
from concordat.plans import driver_tables as D
from concordat.session import CLEANUP, settle

FOLDER = "/root/testdata/sf0.001"


def test_facts_in_one_pass_are_those_of_the_text(spark):
    want, got = D.derive(spark, FOLDER, D.FACTS), D.facts(spark, FOLDER)
    assert got.dtypes == want.dtypes
    assert want.count() > 0 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_lines_are_numbered_once(spark):
    plan = D.facts(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("lineitem") <= 1


def _shuffled(spark) -> set:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p.name for folder in manager.localDirs() for p in Path(folder.getPath()).glob("*/shuffle_*")}


def test_settled_rows_leave_no_shuffle_files(spark):
    before, setting = _shuffled(spark), spark.conf.get(CLEANUP)
    rows = settle(spark.range(10000).selectExpr("id % 5000 AS k").groupBy("k").count())
    assert _shuffled(spark) <= before and spark.conf.get(CLEANUP) == setting
    assert rows.count() == 5000


def test_a_large_playbook_is_dealt_to_many_tasks(spark):
    """Every vendor holds one term; its rules go to more tasks than there are terms, and each meets each vendor once."""
    facts = spark.range(40).selectExpr(
        "CAST(id AS STRING) AS fact_id", "id AS fact_seq", "'hourly_rate' AS predicate", "concat('V', id) AS subject", "concat('$', id) AS value_raw",
        "DATE '2024-01-01' AS effective_date", "CAST(id AS STRING) AS document_id", "'msa' AS document_kind", "CAST(NULL AS STRING) AS scope")
    playbook = spark.range(300).selectExpr(
        "'r' AS ruleset_id", "CAST(id AS INT) AS position", "concat('R', id) AS code", "CASE WHEN id % 2 = 0 THEN 'numeric_max' ELSE 'presence_required' END AS kind",
        "CASE WHEN id % 2 = 0 THEN 'hourly_rate' ELSE 'audit_rights' END AS predicate", "'' AS description",
        "CAST(-1 AS DECIMAL(18,6)) AS max", "CAST(NULL AS DECIMAL(18,6)) AS min", "CAST(NULL AS STRING) AS expr", "'low' AS severity")
    found = rules.evaluate_rules(reconcile(with_keys(facts)), playbook)
    assert found.select("code", "subject").distinct().count() == found.count() == 300 * 40
    parts = found.groupBy("predicate", F.spark_partition_id().alias("part")).count().groupBy("predicate").count().collect()
    assert len(parts) == 2 and all(row["count"] > 8 for row in parts)
