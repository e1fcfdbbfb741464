"""Fact frames for unit tests."""

import datetime

from concordat.operators.reconcile import with_keys

FACT = ("fact_id string, fact_seq bigint, predicate string, subject string, value_raw string, effective_date date, "
        "document_id string, document_kind string, scope string")


def day(text):
    return datetime.date.fromisoformat(text) if text else None


def views(spark, *facts):
    """Facts as (predicate, value, date, kind) plus optional document, scope, subject."""
    rows = []
    for i, fact in enumerate(facts):
        predicate, value, date, kind, *rest = fact
        document, scope, subject = (list(rest) + [None] * 3)[:3]
        rows.append((f"f{i}", i, predicate, subject or "Acme", value, day(date), document or f"d{i}", kind, scope))
    return with_keys(spark.createDataFrame(rows, FACT))
