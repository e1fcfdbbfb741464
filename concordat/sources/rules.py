"""Playbooks as rows (A5)."""

from __future__ import annotations

import json
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from concordat.operators.rules import RULES, validate_rules
from concordat.session import settle
from concordat.sources.lines import numbered_lines

NOT_A_RULE = "the line is not a rule in JSON"
COLUMNS = [c.split()[0] for c in RULES.split(", ")]


def rules_frame(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: (rules, defects) of a playbook in JSON lines; a missing field is NULL, blank lines do not count.

    rules: the columns of a rule with number, the line it stands in.  defects: number, code, problem, line; a
    line that is no rule at all, and what H1 finds wrong with the others.
    """
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    rule = F.from_json("line", f"{RULES}, broken string", {"columnNameOfCorruptRecord": "broken"})
    read = settle(lines.withColumn("rule", rule), "rules")
    broken = F.col("rule").isNull() | F.col("rule.broken").isNotNull()
    rules = read.filter(~broken).select(*[F.col(f"rule.{c}").alias(c) for c in COLUMNS], "number", "line")
    # H1 orders the rules of a set by position; here that is the line
    found = validate_rules(rules.drop("position").withColumnRenamed("number", "position")).withColumnRenamed("position", "number")
    unread = read.filter(broken).select("number", F.lit(None).cast("string").alias("code"), F.lit(NOT_A_RULE).alias("problem"), "line")
    named = found.select("number", "code", "problem").join(read.select("number", "line"), "number")
    return rules.drop("line"), unread.unionByName(named)


def standard_rules() -> list[Row]:
    """The playbook that ships with the package."""
    lines = Path(__file__).with_name("playbook.json").read_text(encoding="utf-8").splitlines()
    rows = []
    for entry in map(json.loads, lines):
        for bound in ("max", "min"):
            if entry.get(bound) is not None:
                entry[bound] = Decimal(str(entry[bound]))
        rows.append(Row(**{c: entry.get(c) for c in COLUMNS}))
    return rows
