"""Reviews, interrupted runs and run states over stored runs."""

import pytest
from pyspark.sql import functions as F

from concordat.operators import reports
from concordat.plans import register_run as R
from concordat.sources.inbox import scan_documents
from concordat.sources.tables import Tables
from letters import AMENDMENT_2, LETTERS, responder, write

VERDICTS = "finding_index bigint, verdict string"


@pytest.fixture(scope="module")
def reviewed(spark, tmp_path_factory):
    """A run, and one more in which the terms of payment are amended; the first finding was rejected."""
    root = tmp_path_factory.mktemp("reviewed")
    tables, inbox = Tables(spark, str(root / "tables")), write(root / "inbox", LETTERS)
    for run in ("r1", "r2"):
        if run == "r2":
            write(root / "inbox", {"change-2.md": AMENDMENT_2})
        R.start_run(tables, "c", run, scan_documents(spark, inbox, every_file=True), classifier=responder("classify"), extractor=responder("extract"))
        if run == "r1":
            R.commit_run(tables, "c", "r1", spark.createDataFrame([(0, "rejected")], VERDICTS))
    return tables


def test_known_findings_are_carried(spark, reviewed):
    tables = reviewed
    first, second = ({f.explanation: f for f in tables.read("findings", "c", r).collect()} for r in ("r1", "r2"))
    assert {f.prior_verdict for f in first.values()} == {None}
    assert all(f.prior_verdict == first[e].status if e in first else f.prior_verdict is None for e, f in second.items())
    queue, counts, resolved = R.review_run(tables, "c", "r2")
    listed = queue.collect()
    assert [q.queue for q in listed] == sorted((q.queue for q in listed), reverse=True) and {q.queue for q in listed} >= {"carried"}
    assert sum(c.findings for c in counts.collect()) == len(second)
    assert {r.explanation for r in resolved.collect()} == set(first) - set(second) != set()


def test_a_reviewer_is_not_asked_twice(spark, reviewed):
    tables = reviewed
    states = lambda: {r.run_id: r.status for r in R.run_states(tables, "c").collect()}
    assert states() == {"r1": "completed", "r2": "awaiting_review"}
    R.commit_run(tables, "c", "r2", spark.createDataFrame([], VERDICTS))
    assert states() == {"r1": "completed", "r2": "completed"}
    first, second = ({f.explanation: f.status for f in tables.read("findings", "c", r).collect()} for r in ("r1", "r2"))
    assert [e for e, s in first.items() if s == "rejected"] == [e for e, s in second.items() if s == "rejected"]
    index = tables.read("verdict_index", "c")
    assert index.count() == len(first) + len(second) and index.filter("prefix <> left(explanation_hash, 2)").isEmpty()


def test_runs_that_were_cut_off(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    R._record(tables, "c", "dead", status="running", current_stage="extract")
    R._record(tables, "c", "done", status="completed")
    R._record(tables, "c", "asks", status="awaiting_review", current_stage="classify")
    assert R.sweep_runs(tables, "c") == ["dead"] and R.sweep_runs(tables, "c") == []
    row = tables.read("runs", "c", "dead").first()
    assert (row.status, row.stage_detail) == ("interrupted", "died during extract")
    assert {r.run_id: r.status for r in R.run_states(tables, "c").collect()} == {"dead": "interrupted", "done": "completed", "asks": "awaiting_classification"}
    assert reports.list_runs(tables.read("runs", "c")).count() == 3
