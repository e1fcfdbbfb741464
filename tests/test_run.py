"""Whole runs: first, unchanged, with one more document, blocked, streamed."""

import pytest
from pyspark.sql import functions as F

from concordat.plans import register_run as R
from concordat.sources.inbox import scan_documents
from concordat.sources.tables import Tables
from concordat.streaming.register_stream import run_if_changed, start_register_stream
from letters import AMENDMENT_2, LETTERS, Counter, responder, write


def options(spark):
    classified, extracted = Counter(spark), Counter(spark)
    return dict(classifier=responder("classify", classified),
                extractor=responder("extract", extracted)), classified, extracted


def commit_all(spark, tables, run):
    return R.commit_run(tables, "c", run, spark.createDataFrame([(0, "rejected")], "finding_index bigint, verdict string"))


def bag(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    tables = Tables(spark, str(root / "tables"))
    inbox = write(root / "inbox", LETTERS)
    calls, classified, extracted = options(spark)
    results, asked = [], []
    for step in ("r1", "r2", "r3"):
        if step == "r3":
            write(root / "inbox", {"change-2.md": AMENDMENT_2})
        results.append(R.start_run(tables, "c", step, scan_documents(spark, inbox, every_file=True), **calls))
        asked.append((classified.seen.value, extracted.seen.value))
        commit_all(spark, tables, step)
    return tables, inbox, results, asked


def test_first_run_finds_what_is_wrong(history):
    tables, _, results, _ = history
    assert results[0].status == "awaiting_review"
    assert results[0].plan["sections_carried_forward"] == 0
    texts = [r.explanation for r in tables.read("findings", "c", "r1").orderBy("finding_index").collect()]
    assert texts[0].startswith("notes.docx skipped: notes.docx: .docx is not a supported format")
    assert any("the invoice used '$100', but the value governing since 2024-06-01 (amendment) was '$120 per hour'. "
               "Difference: -20." in t for t in texts)
    assert any("gives 1000. Difference: 100." in t for t in texts)
    assert any("[PAY-01]" in t and "net 45 days (45), which exceeds the limit of 30" in t for t in texts)
    assert any("[LIAB-01]" in t and "exceeds the limit of 600000" in t for t in texts)


def test_register_states_the_amended_rate(history):
    tables, _, _, _ = history
    content = tables.read("section_versions", "c", "r1").filter(
        "section_key = 'harbour works ltd::hourly_rate'").first().content
    assert '"value":"$120 per hour"' in content
    listed = tables.read("section_parts", "c", "r1").filter("section_key = 'harbour works ltd::hourly_rate'").collect()
    assert [p.content for p in listed if p.part.startswith("superseded/")] == ["$100.00 per hour"]
    assert '"vendor":"Harbour Works Ltd"' in content


def test_unchanged_run_copies_everything_and_asks_nothing(history):
    tables, _, results, asked = history
    assert asked[1] == asked[0]
    assert results[1].plan["sections_rederived"] == 0
    columns = ["section_key", "content", "content_hash", "composer_version"]
    assert bag(tables.read("section_versions", "c", "r1").select(*columns)) == \
        bag(tables.read("section_versions", "c", "r2").select(*columns))
    same = ["section_key", "text", "status"]
    assert bag(tables.read("claims", "c", "r1").select(*same)) == bag(tables.read("claims", "c", "r2").select(*same))


def test_one_amendment_moves_one_section(history):
    tables, _, results, asked = history
    assert (asked[2][0] - asked[1][0], asked[2][1] - asked[1][1]) == (1, 1)
    assert results[2].plan["sections_rederived"] == 1
    log, causes = R.run_changes(tables, "c", "r3")
    moved = log.filter("status <> 'unchanged'").select("section_key", "status").collect()
    assert [tuple(r) for r in moved] == [("harbour works ltd::payment_terms_days", "changed")]
    assert [r.document for r in causes.collect()] == ["change-2.md"]
    # The rule it broke is met now.
    assert not any("[PAY-01]" in r.explanation for r in tables.read("findings", "c", "r3").collect())


def as_built_anew(tables, run, of_run):
    """States, spellings and candidates of a run, and the same from all facts of its documents."""
    present = tables.read("run_documents", "c", run).select("document_id")
    facts = tables.read("facts", "c").join(present, "document_id", "left_semi").drop("unit")
    views = R.reconcile.fact_views(facts, R.documents_with_kinds(tables, "c"))
    whole = {"group_states": R.reconcile.group_states(views), "vendor_spellings": R.reconcile.spellings(views),
             "candidates": R.conflicts.detect(views).select(*R.conflicts.CANDIDATE)}
    for name, frame in whole.items():
        stored = tables.read(name, "c", run)
        assert bag(stored.select(*frame.columns)) == bag(frame.select(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in frame.columns])), (of_run, name)


def test_maintained_register_equals_one_built_anew(spark, history, tmp_path):
    tables, inbox, _, _ = history
    for run in ("r1", "r2", "r3"):
        as_built_anew(tables, run, run)
    # The second amendment came as one batch; nothing else was put in context again.
    batches = {r.batch: r.n for r in tables.read("fact_views", "c").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(b.split("-")[0] for b in batches) == ["r1", "r3"] and [n for b, n in batches.items() if b.startswith("r3")] == [1]


def test_documents_that_leave_or_change(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", {**LETTERS, "change-2.md": AMENDMENT_2})
    calls, _, _ = options(spark)
    R.start_run(tables, "c", "r1", scan_documents(spark, inbox), **calls)
    commit_all(spark, tables, "r1")
    (tmp_path / "inbox" / "change-1.md").unlink()
    R.start_run(tables, "c", "r2", scan_documents(spark, inbox), **calls)
    commit_all(spark, tables, "r2")
    as_built_anew(tables, "r2", "without an amendment")
    assert '"value":"$100.00 per hour"' in tables.read("section_versions", "c", "r2").filter("section_key = 'harbour works ltd::hourly_rate'").first().content
    bill = tables.read("documents", "c").filter("uri LIKE '%bill-july.txt'").select("document_id", F.lit("amendment").alias("answer"))
    R.answer_escalations(tables, "c", bill)
    write(tmp_path / "inbox", {"change-1.md": LETTERS["change-1.md"]})
    result = R.start_run(tables, "c", "r3", scan_documents(spark, inbox), **calls)
    as_built_anew(tables, "r3", "an invoice that is an amendment, and a document that came back")
    assert result.verification["failures"] == 0


def test_only_partitions_of_touched_groups_are_read(spark, history):
    tables, _, _, _ = history
    stored = tables.read("fact_views", "c")
    one = R.maintain.touched_groups(stored.filter("predicate = 'liability_cap'"))
    plan = R.maintain.facts_of_groups(stored, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_commit_keeps_rejected_findings(history):
    tables, _, _, _ = history
    findings = tables.read("findings", "c", "r1").orderBy("finding_index").collect()
    assert findings[0].status == "rejected" and {f.status for f in findings[1:]} == {"approved"}
    assert tables.read("decisions", "c", "r1").count() == len(findings)
    run = tables.read("runs", "c", "r1").first()
    assert run.status == "completed" and run.ended_at is not None


def test_repeating_a_run_replaces_its_rows(spark, history):
    tables, inbox, _, _ = history
    calls, classified, _ = options(spark)
    before = {n: tables.read(n, "c", "r2").count() for n in ("section_versions", "claims", "citations")}
    frames = {n: bag(tables.read(n, "c", "r3").select("section_key")) for n in ("section_versions",)}
    again = tables.read("section_versions", "c", "r2")
    tables.write_run(R.settle(again), "section_versions", "c", "r2")
    assert {n: tables.read(n, "c", "r2").count() for n in before} == before
    assert frames["section_versions"] == bag(tables.read("section_versions", "c", "r3").select("section_key"))


def test_changed_passage_blocks_the_commit(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", LETTERS)
    calls, _, _ = options(spark)
    R.start_run(tables, "c", "r1", scan_documents(spark, inbox), **calls)
    commit_all(spark, tables, "r1")
    chunks = R.settle(tables.read("chunks").withColumn("text", F.regexp_replace("text", r"due net 45", "due soon")))
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("corpus").parquet(tables.path("chunks"))
    result = R.start_run(tables, "c", "r2", scan_documents(spark, inbox), **calls)
    assert result.status == "blocked_by_verification"
    assert result.verification["failures"] == 1
    assert R.previous_run_of(tables, "c") == "r1"
    assert any("[citation_does_not_resolve]" in r.explanation for r in tables.read("findings", "c", "r2").collect())


def test_doubtful_document_waits_for_a_human(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", {"bill.md": LETTERS["bill-july.txt"].replace("kind=invoice", "kind=unknown")})
    calls, _, _ = options(spark)
    assert R.start_run(tables, "c", "r1", scan_documents(spark, inbox), **calls).status == "awaiting_classification"
    asked = tables.read("documents", "c").select("document_id", F.lit(" Invoice ").alias("answer"))
    R.answer_escalations(tables, "c", asked)
    assert R.start_run(tables, "c", "r1", scan_documents(spark, inbox), **calls).status == "awaiting_review"
    assert tables.read("facts", "c").count() == 3
    # The question stays on record among the findings of the run.
    assert any("needs a human to say what it is" in r.explanation for r in tables.read("findings", "c", "r1").collect())


def test_run_that_broke_off_is_started_again(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    # A statement of work that bills: its billed terms are dropped with a finding.
    work = LETTERS["bill-july.txt"].replace("kind=invoice", "kind=sow") + "\n\nThe hourly rate is $90 per hour."
    inbox = write(tmp_path / "inbox", {**LETTERS, "work.md": work})
    calls, classified, extracted = options(spark)

    def loses_contact(candidates):
        raise ConnectionError("judge is gone")

    with pytest.raises(ConnectionError):
        R.start_run(tables, "c", "r1", scan_documents(spark, inbox), judge=loses_contact, **calls)
    asked = (classified.seen.value, extracted.seen.value)
    kept = tables.read("document_findings", "c").count()
    assert kept == 3
    assert R.start_run(tables, "c", "r1", scan_documents(spark, inbox), **calls).status == "awaiting_review"
    assert (classified.seen.value, extracted.seen.value) == asked
    stored = tables.read("findings", "c", "r1")
    assert stored.filter("stage IN ('classify', 'extract')").count() == kept
    assert stored.count() == stored.select("finding_index").distinct().count()


def test_stream_follows_the_inbox(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", {k: v for k, v in LETTERS.items() if k.endswith("ment.md")})
    calls, _, _ = options(spark)
    results = []

    def once():
        q = start_register_stream(tables, "c", inbox, str(tmp_path / "ck"), once=True, on_result=results.append, **calls)
        q.awaitTermination()

    once()
    commit_all(spark, tables, results[0].run_id)
    once()
    assert len(results) == 1  # nothing arrived
    write(tmp_path / "inbox", {"copy.md": LETTERS["agreement.md"]})
    once()
    assert len(results) == 1  # a copy is nothing new
    write(tmp_path / "inbox", {"change-1.md": LETTERS["change-1.md"]})
    once()
    assert len(results) == 2 and results[1].plan["sections_rederived"] == 1


def test_a_batch_opens_and_writes_its_own_files_only(spark, tmp_path, monkeypatch):
    """A second batch of one file writes one text; a file that is gone leaves; a copy keeps its document there."""
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", {k: v for k, v in LETTERS.items() if not k.endswith("docx")} | {"copy.md": LETTERS["change-1.md"]})
    calls, _, _ = options(spark)
    results, written, real = [], [], R.settle

    def spy(rows, name="rows"):
        out = real(rows, name)
        if "text" in out.columns:
            written.append((name, out.count()))
        return out

    def once():
        start_register_stream(tables, "c", inbox, str(tmp_path / "ck"), once=True, on_result=results.append, **calls).awaitTermination()
        commit_all(spark, tables, results[-1].run_id)

    once()
    (tmp_path / "inbox" / "bill-july.txt").unlink()
    (tmp_path / "inbox" / "change-1.md").unlink()
    write(tmp_path / "inbox", {"change-2.md": AMENDMENT_2})
    monkeypatch.setattr(R, "settle", spy)
    once()
    assert [r.status for r in results] == ["awaiting_review"] * 2 and {n for name, n in written if name.startswith("fresh")} == {1}
    assert all(n <= 1 for name, n in written if name != "asked" or n)
    run = results[1].run_id
    names = tables.read("run_documents", "c", run).join(tables.read("documents", "c"), "document_id").select(F.regexp_extract("uri", "[^/]+$", 0)).collect()
    assert {n[0] for n in names} >= {"agreement.md", "change-2.md"} and "bill-july.txt" not in {n[0] for n in names} and len(names) == 3
    as_built_anew(tables, run, "after a batch")


def test_edit_in_place_triggers_a_look(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    inbox = write(tmp_path / "inbox", {"a.md": LETTERS["agreement.md"], "empty.txt": "  \n"})
    calls, _, _ = options(spark)
    assert run_if_changed(tables, "c", inbox, "r1", **calls).status == "awaiting_review"
    assert run_if_changed(tables, "c", inbox, "r2", **calls) is None
    write(tmp_path / "inbox", {"a.md": LETTERS["agreement.md"].replace("net 45", "net 60")})
    assert run_if_changed(tables, "c", inbox, "r2", **calls) is not None
    row = tables.read("section_versions", "c", "r2").filter("section_key LIKE '%payment_terms_days'").first()
    assert '"value":"net 60 days"' in row.content
