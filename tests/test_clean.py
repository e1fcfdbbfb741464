"""A clean corpus: nothing to judge, nothing to review."""

from concordat.plans import register_run as R
from concordat.sources.inbox import scan_documents
from concordat.sources.tables import Tables
from letters import responder, write


def test_clean_corpus_completes_without_a_judge(spark, tmp_path):
    letter = ("AGREEMENT\n\nkind=msa vendor=Quay Ltd date=2024-01-01\n\nThe hourly rate is $90 per hour.\n\n"
              "It is governed by the laws of Norway.")
    inbox = write(tmp_path / "inbox", {"a.md": letter})

    def never(_):
        raise AssertionError("there is nothing to judge")

    tables = Tables(spark, str(tmp_path / "tables"))
    result = R.start_run(tables, "c", "r1", scan_documents(spark, inbox), judge=never,
                         classifier=responder("classify"), extractor=responder("extract"))
    assert result.status == "completed" and result.skipped == ("adjudicate",)
    run = tables.read("runs", "c", "r1").first()
    assert run.ended_at is not None and run.stage_detail.startswith("skipped")
    columns = [c.split()[0] for c in R.rules.RULES.split(", ")]
    rule = R.standard_rules()[1].asDict() | {"kind": "ratio"}
    rows = [tuple(rule[c] for c in columns)]
    result = R.start_run(tables, "c", "r2", scan_documents(spark, inbox), playbook=rows,
                         classifier=responder("classify"), extractor=responder("extract"))
    assert result.status == "awaiting_review"
    finding = tables.read("findings", "c", "r2").first()
    assert finding.severity == "high" and finding.explanation.startswith("Rules were NOT applied: rule #2: PAY-01: kind 'ratio'")
